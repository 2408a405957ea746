"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters and digits. Every k words have a rolling hash; of every w neighbouring
hashes the smallest (the last of equal ones) is kept as a fingerprint, so two texts that share k + w - 1 words in
a row share a fingerprint within them. Fingerprints of documents that pass a bit map of the benchmark's (of a
fixed size; it lets through too many, never too few) are joined to the benchmark's and each hit is extended word
by word to both sides. A common run of k + w - 1 = ``span`` words is an occurrence. Items of fewer words than
``span`` are looked up whole, every hash of that many words being kept (w = 1).

Null texts and texts without a word have no words and no hits. Null ids are kept; null item ids count as items
but are not listed. Repeated rows each have a result; repeated items are one. Empty tables give no rows or no
hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import buffers, groups, word_spans
from .common import saved

_BITS = 26
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CANDIDATE = "family int, fp long, pos long, left_words array<string>, right_words array<string>"


def families(lengths: list[int], span: int, k: int) -> list[tuple[int, int]]:
    """(k, w) of every family: the winnowed one, and one for each length of a shorter item."""
    return [(k, span - k + 1), *[(n, 1) for n in sorted(lengths)]]


def gram_hashes(words: np.ndarray, text_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place on, and whether they lie in one text."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _MIX + words[j : j + n]
    h ^= h >> np.uint64(31)
    return h * _MIX, text_of[:n] == text_of[k - 1 : k - 1 + n]


def winnowed(h: np.ndarray, text_of: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the fingerprints: the last smallest hash of each w neighbours that lie in one text."""
    if w == 1:
        n = len(h)
        return np.flatnonzero(text_of[:n] == text_of[k - 1 : k - 1 + n])
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        lower = h[j : j + n] <= least
        least[lower] = h[j : j + n][lower]
        place[lower] = j
    whole = text_of[:n] == text_of[k + w - 2 : k + w - 2 + n]
    return np.unique((place + np.arange(n))[whole])


def fingerprints(kinds: list[tuple[int, int]], bits: list[np.ndarray] | None, items: bool):
    """Task over (id, text): one row for each text with its words and its fingerprints that pass ``bits``.

    For items a family holds only texts of the family's length, or of ``span`` words and more.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row0 = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in groups(offsets):
                at = offsets[a : b + 1]
                starts, ends, hashes = word_spans(data, at)
                text_of = np.searchsorted(at, starts, "right") - 1
                first = np.searchsorted(text_of, np.arange(b - a + 1))
                n_words = np.diff(first)
                found: dict[int, list] = {}
                for family, (k, w) in enumerate(kinds):
                    h, _ = gram_hashes(hashes, text_of, k)
                    places = winnowed(h, text_of, k, w)
                    if items:
                        n = n_words[text_of[places]]
                        places = places[n == k] if w == 1 else places[n >= k + w - 1]
                    if bits is not None:
                        bit = (h[places] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                        places = places[(bits[family][bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                    for p in places.tolist():
                        t = int(text_of[p])
                        lo, hi = max(int(first[t]), p - w + 1), min(int(first[t + 1]), p + k + w - 1)
                        said = [bytes(data[s:e]).lower().decode() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                        found.setdefault(t, []).append({
                            "family": family, "fp": int(h[p].astype(np.int64)), "pos": p - int(first[t]),
                            "left_words": said[: p - lo][::-1], "right_words": said[p - lo :]})
                kind = pa.struct([("family", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()),
                                  ("left_words", pa.list_(pa.string())), ("right_words", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row0 + np.arange(b - a)), batch.column(0).slice(a, b - a), pa.array(n_words.astype(np.int64)),
                    pa.array([found.get(t, []) for t in range(b - a)], pa.list_(kind))], ["row", "id", "n_words", "found"])
                row0 += b - a

    return run


def _rows(df: DataFrame, id_col: str, text_col: str, task) -> DataFrame:
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"row long, id {kind}, n_words long, found array<struct<{_CANDIDATE}>>")


def _bit_maps(items: DataFrame, n: int) -> list[np.ndarray]:
    """One bit map for each family; the driver gets at most 2**_BITS / 32 words of each."""
    low = F.col("fp").bitwiseAND((1 << _BITS) - 1)
    mask = F.expr("bit_or(shiftleft(1L, cast(low & 31 as int)))")
    found = items.withColumn("low", low).groupBy("family", F.shiftright("low", 5).alias("cell")).agg(mask.alias("mask")).collect()
    maps = [np.zeros(1 << _BITS - 5, "<u4") for _ in range(n)]
    for x in found:
        maps[x.family][x.cell] = x.mask
    return [x.view(np.uint8) for x in maps]


def _same(a: str, b: str) -> Column:
    """How many words from the first on are equal in two word lists."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(equal, False)
    return F.when(at > 0, at - 1).otherwise(F.size(equal)).cast("long")


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: id, n_words, spans (disjoint word ranges that occur in items) and item_ids."""
    rows = saved(_rows(items, item_id_col, item_text_col, fingerprints([], None, True)).select("n_words"), "item-words")
    short = [x.n_words for x in rows.where((F.col("n_words") > 0) & (F.col("n_words") < span)).distinct().collect()]
    kinds = families(short, span, k)
    item_side = _rows(items, item_id_col, item_text_col, fingerprints(kinds, None, True))
    item_side = saved(item_side.select(F.col("id").alias("item_id"), F.inline("found")).drop("pos").distinct(), "item-prints")
    bits = _bit_maps(item_side, len(kinds))
    doc_side = saved(_rows(docs, id_col, text_col, fingerprints(kinds, bits, False)), "doc-prints")
    hits = doc_side.where(F.size("found") > 0).select("row", F.inline("found"))
    other = item_side.withColumnsRenamed({"left_words": "left_item", "right_words": "right_item"})
    needs = F.element_at(F.array(*[F.lit(a + w - 1) for a, w in kinds]), F.col("family") + 1)
    joined = hits.join(other, ["family", "fp"]).select(
        "row", "item_id", "family", "pos", _same("left_words", "left_item").alias("before"),
        _same("right_words", "right_item").alias("after"))
    joined = joined.where(F.col("before") + F.col("after") >= needs)
    ranges = joined.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct((F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b")))).alias("r"),
        F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    merged = F.aggregate("r", F.expr("cast(array() as array<struct<a bigint, b bigint>>)"), lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= x["a"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(done, F.array(x))))
    ranges = ranges.select("row", merged.alias("spans"), F.array_sort("item_ids").alias("item_ids"))
    none = F.expr("cast(array() as array<struct<a bigint, b bigint>>)")
    return doc_side.select("row", F.col("id").alias(id_col), "n_words").join(ranges, "row", "left").select(
        id_col, "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and the verdict: some hit, and ``share`` times the hit words reach the words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean_of(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    keyed = docs.withColumn("_llm_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = judged(contamination(keyed, items, id_col="_llm_key", text_col=text_col))
    return keyed.join(found.where("contaminated").select("_llm_key").distinct(), "_llm_key", "left_anti").select(docs.columns)
