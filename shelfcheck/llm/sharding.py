"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) are sorted by size and each enters the bin with the tightest remaining capacity that
holds it, found in a balanced tree. Groups of one size are placed together, so the driver handles the distinct
group sizes alone: since they sum to at most all bytes, there are fewer than the square root of twice the bytes
of them, and in practice far fewer. Which group of its size goes where follows from its number within the size;
slots are numbers within the shard. Both are counted without a task seeing a whole size or shard.

With a capacity given, as few shards as best fit needs are made. With a number of shards given, the capacity is
the least tried one that needs no more shards, so the shards' sizes are near equal; a group larger than an equal
share of what is left has a shard alone.

A null text has no bytes and is in the group of the empty text. Repeated rows stay together. Null ids are kept.
An empty table gives an empty result. Other columns are kept, unless they carry the names of the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bestfit import Run, best_fit_runs
from .common import numbered, saved


_NEW = ("size", "shard", "slot")


def near_equal_runs(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs of (size, count) classes, largest first, in ``shards`` bins of near equal sizes."""
    left = [list(x) for x in classes]
    alone, total, bins = [], sum(s * c for s, c in classes), shards
    while left and bins > 1 and left[0][0] * bins > total:
        size = left[0][0]
        rank = dict(classes)[size] - left[0][1]
        alone.append(Run(size, rank, 1, shards - bins, 1))
        total, bins = total - size, bins - 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    rest, offset = [(s, c) for s, c in left], shards - bins
    if not rest:
        return alone
    share, slack = -(-total // bins), 0
    while (found := best_fit_runs(rest, share + slack, bins)) is None:
        slack = slack * 2 or 1
    low, high = slack // 2, slack
    while high - low > max(1, share // 10_000):  # between a capacity that fails and one that holds
        middle = (low + high) // 2
        tried = best_fit_runs(rest, share + middle, bins)
        low, high, found = (low, middle, tried) if tried else (middle, high, found)
    done = {r.size: r.rank + r.n for r in alone}
    return alone + [Run(r.size, r.rank + done.get(r.size, 0), r.n, r.first_bin + offset, r.per_bin) for r in found[0]]


def text_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text and one more; null: one."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def best_fit_shards(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id",
                    text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Adds size, shard and slot to the rows, all of a text in one shard. Give ``shards`` or ``capacity``.

    ``columns`` are those of the documents to keep beside the id, all by default; the shuffles carry no others.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != id_col and c not in _NEW and (columns is None or c in columns)]
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(id_col, *columns, key.alias("_llm_key"), text_size(text_col).alias("size"))
    groups = saved(rows.groupBy("_llm_key").agg(F.sum("size").alias("_bytes")), "groups")
    classes = [(x._bytes, x.n) for x in groups.groupBy("_bytes").agg(F.count("*").alias("n")).orderBy(F.desc("_bytes")).toLocalIterator()]
    if not classes:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("_llm_key")
    runs = near_equal_runs(classes, shards) if shards else best_fit_runs(classes, capacity)[0]
    schema = "_bytes long, start long, bin long, per long"
    placed = spark.createDataFrame([(r.size, r.rank, r.first_bin, r.per_bin) for r in runs], schema)
    placed = placed.groupBy("_bytes").agg(F.array_sort(F.collect_list(F.struct("start", "bin", "per"))).alias("runs"))
    ranked = numbered(groups, ["_bytes"], ["_llm_key"], "_rank").join(placed, "_bytes")
    run = F.element_at(F.filter("runs", lambda x: x["start"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_run", run)
    shard = F.col("_run.bin") + F.floor((F.col("_rank") - F.col("_run.start")) / F.col("_run.per"))
    where = ranked.select("_llm_key", shard.cast("int").alias("shard"))
    sharded = saved(rows.join(where, "_llm_key"), "sharded")
    return numbered(sharded, ["shard"], [id_col, "_llm_key"], "slot").select(id_col, *columns, "size", "shard", "slot")
