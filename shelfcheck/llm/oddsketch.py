"""MinHash near duplicates with odd sketches.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets are one class. Each class has
``SAMPLES`` MinHash samples; groups of them are its bands, and all of them are folded into an odd sketch, a bitmap in
which bit (sample number, sample) mod ``BITS`` is flipped for every sample. The exclusive-or of two sketches holds the
parity of the samples that differ, and its population count estimates a high similarity closely, so that of the classes
that meet in a band only those that can reach the similarity are confirmed, on full sets.

Classes meet in two rounds, so that a large group of near copies never lists its pairs: first every class of a band
bucket meets the bucket's pivot; the links so confirmed are contracted to components. Then, in buckets that still hold
several components, tiles of some ``CHUNK`` classes are compared by their sketches, those outside the pivot's component
with all. Only the classes that the sketches leave a partner in another component go on, with 32-bit prints of their
full sets, to be compared exactly in the same tiles; of the pairs that reach the similarity there, one for each class
and other component leaves the task and is confirmed. No pair of one component is looked at again, and no pair of two
components in a bucket is left out.

What can be lost: a pair at the similarity exactly meets in no band with probability (1 - s**ROWS)**BANDS, 4e-7 at 0.8,
and is over the sketch's limit with less than 1e-6; both fall quickly above it.

Null and empty texts and texts without words have the empty set: they are linked with nothing and are their own
component. Texts of fewer words than a shingle have one shingle, the whole sequence. Repeated rows each have a result;
null ids are kept and never the smallest; a null id is its component's only if no other is. An empty table gives an
empty result. Other columns are ignored. A text's set is in one task, whatever its length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import star_components
from .simhash import shingle_hashes

SAMPLES, BITS = 512, 1024
BANDS, ROWS = 28, 4
CHUNK = 1024
MAP_CELLS = 1024
_PIECE = 1 << 13

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_TIMES = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Samples (rows) of each non-empty run of hashes (columns): the least of SAMPLES mixings of their upper halves."""
    runs, low = len(offsets) - 1, (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full((SAMPLES, runs), np.uint32(0xFFFFFFFF))
    at = 0
    while at < runs:  # as many whole runs at a time as fit a piece; a longer run in pieces of its own
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        for a in range(int(offsets[at]), int(offsets[to]), _PIECE):
            part = low[a : min(a + _PIECE, int(offsets[to]))]
            starts = np.maximum(offsets[at:to] - a, 0) if to > at + 1 else np.zeros(1, np.int64)
            for k in range(0, SAMPLES, 16):
                mixed = (part[None, :] ^ _FLIP[k : k + 16, None]) * _TIMES[k : k + 16, None]
                np.minimum(out[k : k + 16, at:to], np.minimum.reduceat(mixed, starts, axis=1), out=out[k : k + 16, at:to])
        at = to
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches as signed 64-bit words, one row for each column of samples."""
    numbered = samples.astype(np.uint64) << np.uint64(16) | np.arange(SAMPLES, dtype=np.uint64)[:, None]
    numbered *= np.uint64(0x9E3779B97F4A7C15)
    numbered ^= numbered >> np.uint64(32)
    numbered *= np.uint64(0xD6E8FEB86659FD93)
    bit = (numbered >> np.uint64(40)).astype(np.int64) % BITS
    runs = samples.shape[1]
    flips = np.bincount((bit + np.arange(runs) * BITS).ravel(), minlength=runs * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(runs, BITS), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one row for each column of samples."""
    out = np.zeros((BANDS, samples.shape[1]), np.uint64)
    for r in range(ROWS):
        out = (out ^ samples[r : BANDS * ROWS : ROWS].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    out = (out ^ np.arange(BANDS, dtype=np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    return np.ascontiguousarray((out ^ out >> np.uint64(32)).T)


def flipped(differ: float) -> float:
    """Bits expected in the exclusive-or of two sketches when so many samples differ."""
    return BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ))


def similarity(bits: float) -> float:
    """The estimate of a similarity from the population count of the exclusive-or."""
    share = min(2 * bits / BITS, 1 - 1e-9)
    return 1 - math.log(1 - share) / math.log(1 - 2 / BITS) / 2 / SAMPLES


def limit(least: float) -> int:
    """Bits that a pair of this similarity has at most, five deviations beyond what is expected."""
    mean = SAMPLES * (1 - least)
    flips = 2 * mean
    slope = math.exp(-2 * flips / BITS)
    by_bits = BITS / 4 * (1 - slope**2) - slope**2 * flips  # of a fixed number of flips
    by_samples = SAMPLES * least * (1 - least) * (2 * slope) ** 2
    return math.ceil(flipped(mean) + 5 * math.sqrt(max(by_bits, 0) + by_samples))


def _sets(batch) -> Iterator[np.ndarray]:
    lists = batch.column(batch.num_columns - 1)
    offsets = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.unique(flat[a:b])


def _signed(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(_sets(part))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes[full])]).astype(np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *sets])
            samples = minhashes(flat, offsets)
            sketch, bands = sketches(samples), band_keys(samples).view(np.int64)
            cls, sk, bd = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(full.tolist()):
                cls[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sk[i], bd[i] = sketch[k], bands[k]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sizes), pa.array(cls, pa.binary()), pa.array(sk, pa.list_(pa.int64())), pa.array(bd, pa.list_(pa.int64()))],
                [*part.schema.names[:-1], "n_shingles", "_cls", "_sketch", "_bands"])


def _hashed(docs: DataFrame, columns: list[Column], size: int, text_col: str) -> DataFrame:
    split, hashes = shingle_hashes(F.col(text_col), size)
    rows = docs.select(*columns, split.alias("_w"))
    return rows.select(*[c for c in rows.columns if c != "_w"], hashes.alias("_h"))


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def prints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the text's key, n_shingles, class, sketch and band keys (null for an empty set)."""
    kind = dict(docs.dtypes)[id_col]
    rows = _hashed(docs, [F.col(id_col).alias("_id"), _text_key(text_col).alias("_text")], size, text_col)
    return rows.mapInArrow(_signed, f"_id {kind}, _text binary, n_shingles long, _cls binary, _sketch array<long>, _bands array<long>")


def _full(halves: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [((s >> np.uint64(32)).astype(np.uint32) if halves else s).tobytes() for s in _sets(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "set"])

    return run


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is marked in a bit map of the keys: all that are among them, and few others.

    The map has ``MAP_CELLS`` cells of 32 768 bits, whatever the number of keys, so it is broadcast.
    """
    place = F.xxhash64(key)
    cell, at = F.shiftright(place, 15).bitwiseAND(MAP_CELLS - 1), place.bitwiseAND((1 << 15) - 1)
    maps = keys.groupBy(cell.alias("_cell")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("_cell", cell).join(F.broadcast(saved(maps, "key-bits")), "_cell")
    return kept.where(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(rows.columns)


def _full_sets(docs: DataFrame, classes: DataFrame, size: int, text_col: str, halves: bool = False) -> DataFrame:
    """The columns of the classes (cls, _text, ...; a written table) and the set of each, from one text; written.

    With ``halves`` the upper 32 bits of each hash stand for it. Only texts of the classes, and few others, are shuffled.
    """
    texts = docs.select(_text_key(text_col).alias("_text"), F.col(text_col).alias("t"))
    texts = _among(texts, classes, "_text").groupBy("_text").agg(F.max("t").alias("t"))
    texts = texts.join(classes.select("_text"), "_text", "left_semi").join(classes, "_text")
    own = classes.drop("_text")
    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes)
    rows = _hashed(texts, [F.col(c) for c in own.columns], size, "t")
    return saved(rows.mapInArrow(_full(halves), schema + ", set binary"), "sets")


def _confirmed(per_cent: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a_out, b_out = [], []
            for a, b, x, y in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= per_cent * (len(x) + len(y) - both):
                    a_out.append(a.as_py())
                    b_out.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], ["a", "b"])

    return run


def _near(a: str, b: str, most: int, words: int) -> Column:
    """Native population count of the exclusive-or of two sketches, within the limit."""
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)]
    return sum(bits[1:], bits[0]) <= most


def _tile(tile) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Components (as 64-bit numbers), classes, set sizes and sketches of a tile's classes."""
    comp, cls, n, sketch = (tile.values.field(i) for i in range(4))
    words = sketch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return comp.to_numpy(zero_copy_only=False), cls.to_pylist(), n.to_numpy(zero_copy_only=False), words.reshape(len(cls), -1)


def _partnered(most: int, per_cent: int):
    """Of each pair of tiles, the classes that sketches and sizes leave a partner in another component."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, found = [], []
            for key, home, guest in zip(*batch.columns, strict=True):
                (ac, a, an, ask), (bc, b, bn, bsk) = _tile(home), _tile(guest)
                met, own = np.zeros(len(b), bool), len(found)
                for i in range(len(a)):
                    fits = np.flatnonzero((bc != ac[i]) & (100 * np.minimum(bn, an[i]) >= per_cent * np.maximum(bn, an[i])))
                    fine = fits[np.bitwise_count(bsk[fits] ^ ask[i]).sum(1, dtype=np.int64) <= most]
                    if len(fine):
                        met[fine] = True
                        found.append(a[i])
                found += [b[j] for j in np.flatnonzero(met).tolist()]
                keys += [key.as_py()] * (len(found) - own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "cls"])

    return run


def _prints_of(tile) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit prints of a tile's sets, all together, and where each set starts."""
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in tile.values.field(3)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    return np.concatenate(sets), starts


def _linked(per_cent: int):
    """Of each pair of tiles, pairs of classes whose sets reach the similarity by 32-bit prints, which never show less
    than the sets have in common: one for each home class and other component."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a_out, b_out = [], []
            for _, home, guest in zip(*batch.columns, strict=True):
                (ac, a, an), (bc, b, bn) = ([tile.values.field(i) for i in range(3)] for tile in (home, guest))
                ac, bc, an, bn = (x.to_numpy(zero_copy_only=False) for x in (ac, bc, an, bn))
                (x, x_at), (y, y_at) = _prints_of(home), _prints_of(guest)
                said, number = np.unique(np.concatenate([x, y]), return_inverse=True)
                x, y, marked = number[: len(x)], number[len(x) :], np.zeros(len(said), bool)
                for i in range(len(a)):
                    own = x[x_at[i] : x_at[i + 1]]
                    marked[own] = True
                    both = np.add.reduceat(marked[y], y_at[:-1], dtype=np.int64)
                    marked[own] = False
                    hits = np.flatnonzero((bc != ac[i]) & (100 * both >= per_cent * (an[i] + bn - both)))
                    hits = hits[np.unique(bc[hits], return_index=True)[1]]
                    a_out += [a[i].as_py()] * len(hits)
                    b_out += [b[j].as_py() for j in hits.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], ["a", "b"])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _with_class(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows with the columns that ``table`` has for their class.

    A class is joined once with the list of its rows, one for each band at most, not once for each row.
    """
    own = [c for c in rows.columns if c != "cls"]
    listed = rows.groupBy("cls").agg(F.collect_list(F.struct(*own)).alias("_rows")).join(table, "cls")
    extra = [c for c in table.columns if c != "cls"]
    return listed.select("cls", *extra, F.explode("_rows").alias("_r")).select("_r.*", "cls", *extra)


class _Search:
    """The classes of one corpus and how they meet; every step is a written table."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, per_cent: int, text_col: str, most: int, words: int):
        self.docs, self.classes, self.size, self.per_cent, self.text_col = docs, classes, size, per_cent, text_col
        self.most, self.words, self.links = most, words, None
        keyed = classes.select(F.explode("bands").alias("key"), "cls").withColumn("c8", F.xxhash64("cls"))
        buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("c8").alias("pivot")).where("m > 1").drop("m")
        self.met = saved(keyed.join(buckets, "key"), "buckets")

    def by_pivot(self) -> DataFrame:
        pivots = self.met.where("c8 = pivot").select("key", F.col("cls").alias("b"))
        pairs = self.met.where("c8 <> pivot").select("key", F.col("cls").alias("a")).join(pivots, "key").select("a", "b").distinct()
        own = self.classes.select("cls", "n", "sketch")
        for side in "ab":
            pairs = pairs.join(own.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.per_cent
        return pairs.where(sized & _near("s_a", "s_b", self.most, self.words)).select("a", "b")

    def across(self, roots: DataFrame) -> DataFrame:
        """Pairs of different components in one bucket that reach the similarity; one is outside the pivot's component."""
        named = roots.select(F.col("node").alias("cls"), "root")
        rows = self.met.join(named, "cls", "left").withColumn("comp", F.xxhash64(F.coalesce("root", "cls"))).drop("root")
        rows = _with_class(rows.join(self._mixed(rows), "key"), self.classes.select("cls", "n", "sketch"))
        pairs = self._tiles(rows, F.lit(CHUNK), ["comp", "cls", "n", "sketch"])
        left = saved(pairs.mapInArrow(_partnered(self.most, self.per_cent), "key long, cls binary").distinct(), "partnered")
        sets = self.sets(left.select("cls").distinct(), halves=True)
        rows = rows.drop("main", "m", "hashes", "sketch").join(left, ["key", "cls"])
        rows = _with_class(rows.join(self._mixed(rows), "key"), sets)
        # a tile has some CHUNK sets of 64 shingles, or as many hashes in fewer sets
        pairs = self._tiles(rows, F.least(F.lit(CHUNK), 1 + F.floor(64 * CHUNK * F.col("m") / F.col("hashes"))), ["comp", "cls", "n", "set"])
        return _ordered(pairs.mapInArrow(_linked(self.per_cent), "a binary, b binary"))

    @staticmethod
    def _mixed(rows: DataFrame) -> DataFrame:
        """Keys with several components: the pivot's one (or the least, where the pivot is gone), rows and hashes."""
        pivot = F.min(F.when(F.col("c8") == F.col("pivot"), F.col("comp")))
        size = F.sum("n") if "n" in rows.columns else F.lit(None).cast("long")
        return rows.groupBy("key").agg(
            F.coalesce(pivot, F.min("comp")).alias("main"), F.count("*").alias("m"), size.alias("hashes"),
            (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").drop("mixed")

    @staticmethod
    def _tiles(rows: DataFrame, most: Column, columns: list[str]) -> DataFrame:
        """(key, home tile, guest tile): all classes of a key outside its main component with all its classes."""
        rows = rows.withColumn("outside", F.col("comp") != F.col("main")).withColumn("chunks", F.ceil(F.col("m") / most).cast("int"))
        rows = rows.withColumn("chunk", F.pmod(F.col("c8"), F.col("chunks")).cast("int"))
        tiles = saved(rows.groupBy("key", "chunk", "chunks", "outside").agg(F.collect_list(F.struct(*columns)).alias("tile")), "tiles")
        homes = tiles.where("outside").select(  # the smaller side goes to the chunks of the other, so that a hot key is many tasks
            "key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("chunk").alias("home"), F.col("tile").alias("a"))
        guests = tiles.select("key", "chunk", "outside", F.col("tile").alias("b"))
        met = homes.join(guests, ["key", "chunk"]).where(~F.col("outside") | (F.col("chunk") >= F.col("home")))
        return met.select("key", "a", "b")

    def sets(self, needed: DataFrame, halves: bool = False) -> DataFrame:
        """The columns of ``needed`` (cls, ...; a row for each class) and the full sets, or their 32-bit prints."""
        classes = needed.join(self.classes.select("cls", F.col("text").alias("_text")), "cls")
        return _full_sets(self.docs, saved(classes, "needed"), self.size, self.text_col, halves)

    def confirm(self, pairs: DataFrame) -> bool:
        """Adds the pairs that reach the similarity on full sets to the links; whether there was any.

        A set goes to the partners of its class, which are pivots, one for each band at most, or classes of other components.
        """
        pairs = saved(pairs, "candidates")
        sides = pairs.select(F.col("a").alias("cls"), F.col("b").alias("partner")).union(
            pairs.select(F.col("b"), F.lit(None).cast("binary")).distinct())
        sets = self.sets(sides.groupBy("cls").agg(
            F.collect_list("partner").alias("partners"), F.bool_or(F.col("partner").isNull()).alias("is_partner")))
        sent = sets.select(F.explode("partners").alias("b"), F.col("cls").alias("a"), F.col("set").alias("x"))
        both = sent.join(sets.where("is_partner").select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        found = saved(both.mapInArrow(_confirmed(self.per_cent), "a binary, b binary"), "links")
        self.links = found if self.links is None else self.links.union(found)
        return not found.isEmpty()


def components(docs: DataFrame, classes: DataFrame, size: int, per_cent: int, text_col: str, most: int | None = None,
               words: int = BITS // 64, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of the classes that have a link. ``classes`` is a written table: cls, n, text, sketch, bands.

    ``most`` bounds the bits by which the sketches, of so many 64-bit words, of a linked pair differ. ``more`` has pairs
    (a, b) that are confirmed with those of the pivots.
    """
    search = _Search(docs, classes, size, per_cent, text_col, limit(per_cent / 100) if most is None else most, words)
    first = search.by_pivot()
    search.confirm(first if more is None else _ordered(first.unionByName(more)))
    roots = saved(star_components(search.links), "roots")
    if search.confirm(search.across(roots)):
        roots = saved(star_components(search.links), "roots")
    return roots


def near_duplicates(docs: DataFrame, size: int = 4, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id reachable) and kept (whether it is the row's own id)."""
    rows = saved(prints(docs, size, id_col, text_col), "odd-prints")
    full = rows.where(F.col("_cls").isNotNull())
    classes = full.groupBy(F.col("_cls").alias("cls")).agg(
        F.min("_id").alias("first"), F.min("_text").alias("text"), F.first("n_shingles").alias("n"),
        F.first("_sketch").alias("sketch"), F.first("_bands").alias("bands"))
    classes = saved(classes, "classes")
    roots = components(docs, classes, size, per_cent, text_col)
    named = classes.select("cls", "first").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = saved(named.select("cls", "first", F.coalesce("root", "cls").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = saved(named.join(least, "root").select(F.col("cls").alias("_cls"), "component"), "component-ids")
    found = rows.select("_id", "n_shingles", "_cls").join(named, "_cls", "left")
    component = F.when(F.col("_cls").isNull(), F.col("_id")).otherwise(F.col("component"))
    return found.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"),
                        F.col("_id").eqNullSafe(component).alias("kept"))
