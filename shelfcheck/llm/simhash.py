"""SimHash near duplicates by tiled exact comparison.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word shingles. Equal fingerprints become
one. Tiles hold the distinct fingerprints that have the same population counts in each of ``BLOCKS`` blocks of
bits; the counts of two fingerprints differ in all by no more than their bits do, so a tile is only compared with
tiles whose counts differ by ``radius`` or less, and all other tile pairs are skipped. A pair of tiles is compared
in numpy by exclusive-or and bit counts; large tiles are cut into chunks, so no task holds more than two. Of a
pair's links only a spanning forest leaves the task, which keeps every component and never lists the pairs of a
large group.

A null text is empty and has fingerprint zero, as has a text without words; they are linked like any others.
Repeated rows each have a result. Null ids are kept and never the smallest. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE_GAP, saved, words
from .components import star_components
from .pieces import release

BLOCKS, CHUNK = 4, 2048
_LANES = np.uint64(0x0001000100010001)


def shingle_hashes(text, size: int):
    """XXH64 (seed 42) of the word shingles of a text; fewer words: of all of them; none: no hash."""
    w = F.col("_w")
    n = F.size(w)
    full = F.transform(F.slice(w, F.lit(1), F.greatest(n - size + 1, F.lit(0))), lambda x, i: F.xxhash64(
        F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, size)])))
    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return words(text, NON_SPACE_GAP), F.when(n >= size, full).otherwise(short)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of hashes; no hash: zero."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # runs are cut so that 16-bit counters do not overflow
    cuts = np.concatenate([np.arange(a, b, 60_000) for a, b in zip(offsets[full], offsets[full + 1], strict=True)])
    owner = np.searchsorted(offsets[full], cuts, "right") - 1
    half = n[full]
    for j in range(16):
        sums = np.add.reduceat(hashes >> np.uint64(j) & _LANES, cuts)
        for lane in range(4):
            part = (sums >> np.uint64(16 * lane) & np.uint64(0xFFFF)).astype(np.int64)
            count = np.bincount(owner, part, len(full)).astype(np.int64)
            out[full] |= (2 * count > half).astype(np.uint64) << np.uint64(16 * lane + j)
    return out


def _fold(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = np.asarray(lists.offsets)
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
        fp = majority(flat, (offsets - offsets[0]).astype(np.int64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keys: list[str], size: int = 3, text_col: str = "text") -> DataFrame:
    """The key columns and the fingerprint ``fp`` as a signed long."""
    split, hashes = shingle_hashes(F.col(text_col), size)
    rows = docs.select(*keys, split.alias("_w")).select(*keys, hashes.alias("_h"))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keys).dtypes) + ", fp long"
    return rows.mapInArrow(_fold, schema)


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of block counts within the radius, one of each pair of opposite ones, and none."""
    found: list[tuple[int, ...]] = [()]
    for _ in range(BLOCKS):
        found = [(*x, d) for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in found if x >= (0,) * BLOCKS]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows and columns of a matrix."""
    rows, cols = np.nonzero(linked)
    if len(rows) < 64:
        return list(zip(rows.tolist(), cols.tolist(), strict=True))
    new_row, new_col, edges = linked.any(1), linked.any(0), []
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        new_row[start] = False
        todo = [(True, int(start))]
        while todo:
            is_row, x = todo.pop()
            new = new_col if is_row else new_row
            met = np.flatnonzero((linked[x] if is_row else linked[:, x]) & new)
            new[met] = False
            edges += [(x, m) if is_row else (m, x) for m in met.tolist()]
            todo += [(not is_row, m) for m in met.tolist()]
    return edges


def _compare(radius: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a_out, b_out = [], []
            for a, b, same in zip(*(batch.column(i) for i in range(3)), strict=True):
                a = np.frombuffer(a.as_buffer(), ">u8")
                b = np.frombuffer(b.as_buffer(), ">u8")
                linked = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                if same.as_py():
                    np.fill_diagonal(linked, False)
                if linked.any():
                    for i, j in forest(linked):
                        a_out.append(a[i])
                        b_out.append(b[j])
            to = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([to(a_out), to(b_out)], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """A spanning set of links (a, b) between distinct fingerprints ``fp``, a written table."""
    bits = 64 // BLOCKS
    keys = [f"k{i}" for i in range(BLOCKS)]
    count = lambda i: F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND((1 << bits) - 1)).cast("int")
    keyed = prints.select("fp", *[count(i).alias(k) for i, k in enumerate(keys)])
    sizes = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    chunked = keyed.join(sizes, keys).withColumn("_c", F.pmod(F.xxhash64("fp"), F.col("_chunks")).cast("int"))
    tiles = chunked.groupBy(*keys, "_c").agg(F.array_join(F.sort_array(F.collect_list(F.lpad(F.hex("fp"), 16, "0"))), "").alias("h"))
    tiles = saved(tiles.select(*keys, "_c", F.unhex("h").alias("tile")), "tiles")
    moved = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(x)]) for x in _offsets(radius)]))
    guests = tiles.select(*keys, F.col("_c").alias("_g"), F.col("tile").alias("guest"), moved.alias("d"))
    home = F.expr(" and ".join(f"d.d{i} = 0" for i in range(BLOCKS)))
    guests = guests.select(*[(F.col(k) + F.col(f"d.d{i}")).alias(k) for i, k in enumerate(keys)], "_g", "guest", home.alias("home"))
    pairs = tiles.join(guests, keys).where(~F.col("home") | (F.col("_g") >= F.col("_c")))
    pairs = pairs.select("tile", "guest", (F.col("home") & (F.col("_g") == F.col("_c"))).alias("same"))
    return saved(pairs.mapInArrow(_compare(radius), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: the id, ``keys``, fp and component_id, the smallest id in its component."""
    prints = saved(fingerprints(docs, [id_col, *keys], size, text_col), "prints")
    distinct = saved(prints.groupBy("fp").agg(F.min(id_col).alias("_first")), "distinct-prints")
    roots = star_components(links(distinct, radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    firsts = linked.groupBy("root").agg(F.min("_first").alias("component_id"))
    linked = linked.join(firsts, "root").select("fp", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "_first").alias("component_id"))
    named = saved(named, "components")  # a join of two tables, so that a fingerprint with many rows can be split
    return prints.join(named, "fp").select(id_col, *keys, "fp", "component_id")


# ---------------------------------------------------------------------------
# Groups of verified similarity
# ---------------------------------------------------------------------------

#: Fingerprints of a text for the search at a similarity of word shingles, each with a hash function of its own over
#: pairs of words; bands are so many bits wide, and linked texts differ by so many bits at most.
FINGERPRINTS, BAND_BITS, WIDE_RADIUS = 12, 24, 168


def gram_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """64-bit hashes of the word n-grams of each run of word hashes; a shorter run is one gram, an empty run none."""

    def rolled(w: np.ndarray, k: int) -> np.ndarray:
        g = np.full(len(w) - k + 1, 0x243F6A8885A308D3, np.uint64)
        for j in range(k):
            g = (g ^ w[j : len(w) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(32)
        return g

    whole = rolled(hashes, size) if len(hashes) >= size else np.empty(0, np.uint64)
    return [whole[a : b - size + 1] if b - a >= size else rolled(hashes[a:b], b - a) if b > a else hashes[:0]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def wide_fingerprints(grams: list[np.ndarray]) -> np.ndarray:
    """FINGERPRINTS majorities over seeded hashes, as words of one row for each list of hashes."""
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
    flat, out = np.concatenate([np.empty(0, np.uint64), *grams]), []
    for seed in range(FINGERPRINTS):
        mixed = (flat ^ np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        out.append(majority(mixed * np.uint64(0x9E3779B97F4A7C15), offsets))
    return np.stack(out, 1) if grams else np.empty((0, FINGERPRINTS), np.uint64)


def band_values(words: np.ndarray) -> np.ndarray:
    """Numbered values of the bands of BAND_BITS bits of each row of words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    n = bits.shape[1] // BAND_BITS
    values = bits[:, : n * BAND_BITS].reshape(len(words), n, BAND_BITS).astype(np.int64) @ (1 << np.arange(BAND_BITS, dtype=np.int64))
    return values + (np.arange(n, dtype=np.int64) << BAND_BITS)


def _grouped(size: int):
    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        release()
        longs = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(part.num_columns - 1)
                offsets = np.asarray(lists.offsets)
                flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
                offsets = (offsets - offsets[0]).astype(np.int64)
                sets = [np.unique(g) for g in gram_hashes(flat, offsets, size)]
                words = wide_fingerprints(gram_hashes(flat, offsets, 2))
                bands = band_values(words)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array(list(words.view(np.int64)), longs), pa.array([b if len(s) else [] for b, s in zip(bands, sets, strict=True)], longs)],
                    [*part.schema.names[:-1], "_n", "_cls", "_sketch", "_bands"])

    return run


def tile_candidates(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of classes with words whose first fingerprints are equal or linked on the tiles (``links``).

    The least class of a fingerprint stands for it, so that a fingerprint of many classes never lists its pairs.
    """
    prints = classes.where("n > 0").select("cls", F.get("sketch", F.lit(0)).alias("fp"))
    pivots = saved(prints.groupBy("fp").agg(F.min("cls").alias("pivot")), "tile-pivots")
    equal = prints.join(pivots, "fp").where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    near = links(pivots, radius)
    for side in "ab":
        near = near.join(pivots.select(F.col("fp").alias(side), F.col("pivot").alias("_" + side)), side)
    return equal.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def similar_groups(docs: DataFrame, size: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: the id, ``keys`` and component_id, the smallest id that links of this similarity reach.

    Candidates are linked on the tiles of their first fingerprint over pairs of words, or agree in a band of one of
    their fingerprints and differ by ``WIDE_RADIUS`` bits at most, which meets pairs that the tiles' few bits leave
    out. All are confirmed by the Jaccard similarity of their sets of word shingles. A pair that has just the
    similarity by edits spread over a long text is met with a probability of 0.97, one above it sooner. Texts without
    words are equal; null ids are never the smallest.
    """
    from . import oddsketch

    hashes = F.transform(words(F.col(text_col), NON_SPACE_GAP), lambda w: F.xxhash64(w))
    text = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.select(F.col(id_col).alias("_id"), *keys, text.alias("_text"), hashes.alias("_h"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_h").dtypes)
    rows = saved(rows.mapInArrow(_grouped(size), schema + ", _n long, _cls binary, _sketch array<long>, _bands array<long>"), "wide-prints")
    classes = saved(rows.groupBy(F.col("_cls").alias("cls")).agg(
        F.min("_id").alias("first"), F.min("_text").alias("text"), F.first("_n").alias("n"), F.first("_sketch").alias("sketch"),
        F.first("_bands").alias("bands")), "wide-classes")
    roots = oddsketch.components(docs, classes, size, per_cent, text_col, WIDE_RADIUS, FINGERPRINTS, tile_candidates(classes))
    named = classes.select("cls", "first").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = saved(named.select("cls", "first", F.coalesce("root", "cls").alias("root")), "wide-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(named.join(least, "root").select(F.col("cls").alias("_cls"), F.col("root").alias("_root"), "component_id"), "wide-ids")
    return rows.select("_id", *keys, "_cls").join(named, "_cls").select(F.col("_id").alias(id_col), *keys, "_root", "component_id")


def _first_of_each(docs: DataFrame, found, group: str, id_col: str, text_col: str) -> DataFrame:
    """The documents, all columns, with one row of each group of ``found(keyed)``: the smallest id, of equal ids one row."""
    keyed = docs.withColumn("_llm_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    best = found(keyed).groupBy(group).agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_llm_key").alias("k"))).alias("m"))
    best = best.select(F.col("m.i").alias("_llm_id"), F.col("m.k").alias("_llm_k")).distinct()
    kept = keyed.join(best, keyed[id_col].eqNullSafe(F.col("_llm_id")) & (keyed["_llm_key"] == F.col("_llm_k")), "left_semi")
    return kept.dropDuplicates([id_col, "_llm_key"]).select(docs.columns)


def one_of_similar(docs: DataFrame, size: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each group of ``similar_groups``: the smallest id, of equal ids one row."""
    return _first_of_each(docs, lambda keyed: similar_groups(keyed, size, per_cent, id_col, text_col, ("_llm_key",)), "_root", id_col, text_col)


def one_of_each(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each component: the smallest id, of equal ids one row."""
    keyed = docs.withColumn("_llm_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = near_duplicates(keyed, size, radius, id_col, text_col, ("_llm_key",))
    group = F.when(F.col("component_id").isNull(), F.col("_llm_key")).otherwise(F.col("component_id").cast("string"))
    best = found.groupBy(group.alias("g"), F.col("component_id").isNull().alias("z")).agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_llm_key").alias("k"))).alias("m"))
    best = best.select(F.col("m.i").alias("_llm_id"), F.col("m.k").alias("_llm_key")).distinct()
    kept = keyed.join(best.withColumnRenamed("_llm_key", "_llm_k"), keyed[id_col].eqNullSafe(F.col("_llm_id")) & (keyed["_llm_key"] == F.col("_llm_k")), "left_semi")
    return kept.dropDuplicates([id_col, "_llm_key"]).select(docs.columns)
