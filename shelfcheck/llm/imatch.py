"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band: as the band has a lower end relative to the
number of documents, there are at most (mean distinct terms of a document) / ``LOW`` of them, however many documents
there are. Up to ``BROADCAST_ROWS`` of them are broadcast, more are joined by shuffle. A document's distinct lexicon
terms are sorted and hashed: all of them, and those in each of several random subsets of the lexicon. The subsets
come in ``len(LEVELS)`` sizes, so that long and short texts both have some that hold a few of their terms. Terms
are held as 64-bit hashes; which subsets a term is in follows from bits of its hash.

The likeness of two fingerprints is 1 if their hashes of all terms are equal; else it is the share of equal
subset hashes among those that are not empty in both, taken at the level where it is largest and at least
``ENOUGH`` count, or over all levels if there is none.

A null text is empty. A text without lexicon terms is hashed by all its terms, one without terms by its characters.
The next document is the one with the next larger id, after the last the first; null ids come first, equal ids are
ordered by a hash of the text, and of rows repeated as a whole each has the next copy as its next. A single
document is its own next. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, words

LOW, HIGH = 0.002, 0.15
BROADCAST_ROWS = 1_000_000
#: Bits of a term's hash that must be zero: subsets hold one in 8, 32, 128 and 512 terms of the lexicon.
LEVELS = (3, 5, 7, 9)
SUBSETS, ENOUGH = 7, 3
#: Spark's hash of an empty list.
EMPTY = 42
KEY = ["id_null", "id_text", "h"]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text_col: str = "text") -> DataFrame:
    """Hashes ``t`` of the terms in at least ``low`` and at most ``high`` of the documents."""
    terms = docs.select(F.explode(F.array_distinct(words(F.col(text_col)))).alias("term")).select(F.xxhash64("term").alias("t"))
    n = docs.count()
    found = terms.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df").between(low * n, high * n))
    return saved(found.select("t"), "lexicon")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).isNull().alias("id_null"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id_text"),
        F.xxhash64(text).alias("h"), F.col(id_col).alias("id"), text.alias("text"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Per distinct (id, text hash): its copies, the keys of the next and the previous and the latter's length.

    Keys are ordered in ranges; the first and last key of each range meet in a table of one row for each range.
    """
    keys = rows.groupBy(*KEY).agg(F.first("id").alias("id"), F.first(F.char_length("text")).alias("n"), F.count("*").alias("copies"))
    dealt = saved(keys.repartitionByRange("id", "h").withColumn("range", F.spark_partition_id()), "order")
    here = F.struct("id", "h", *KEY[:2], "n")
    within = Window.partitionBy("range").orderBy("id", "h")
    ends = dealt.groupBy("range").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    by_range, whole = Window.orderBy("range"), Window.partitionBy(F.lit(0))
    ends = ends.select("range", F.coalesce(F.lead("first").over(by_range), F.min("first").over(whole)).alias("after"),
                       F.coalesce(F.lag("last").over(by_range), F.max("last").over(whole)).alias("before"))
    linked = dealt.withColumns({"next": F.lead(here).over(within), "prev": F.lag(here).over(within)}).join(ends, "range")
    at = F.coalesce("next", "after"), F.coalesce("prev", "before")
    return saved(linked.select(
        *KEY, "id", "n", "copies", *[at[0][k].alias(f"next_{k}") for k in KEY], *[at[1][k].alias(f"prev_{k}") for k in KEY],
        at[1]["n"].alias("prev_n")), "neighbours")


def edited_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its edited text: the last quarter of its characters replaced by the first of the next document."""
    rows = _rows(docs, id_col, text_col)
    near = neighbours(rows)
    # only the key and the text, so that the heads below read the same exchange
    full = rows.drop("id").join(near, KEY).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("h")))
    heads = full.where("copy = 1").select(
        *[F.col(f"prev_{k}").alias(k) for k in KEY], F.expr("substring(text, 1, cast(floor(prev_n / 4) as int))").alias("head"))
    both = full.join(heads, KEY, "left")
    quarter = "cast(floor(n / 4) as int)"
    return both.withColumn("edited", F.expr(
        f"concat(substring(text, 1, n - {quarter}), substring(if(copy < copies, text, head), 1, {quarter}))"))


def _whole(terms: str, text: str) -> Column:
    return F.when(F.size(terms) > 0, F.xxhash64(F.array_sort(terms))).otherwise(F.xxhash64(text))


def _hashed(terms: str) -> Column:
    """The hashes of a sorted list of term hashes in all subsets, level after level."""
    masks = [((1 << bits) - 1) << 9 * j for bits in LEVELS for j in range(SUBSETS)]
    # a lambda for each mask: the subset's terms have none of its bits
    return F.array(*[F.hash(F.filter(terms, (lambda m: lambda x: x.bitwiseAND(F.lit(m)) == 0)(m))) for m in masks])


def likeness(a: str, b: str, all_a: str, all_b: str) -> Column:
    """Of two lists of subset hashes and the hashes of all terms."""
    pairs = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))
    some = lambda p: F.size(F.filter(p, lambda z: (z["x"] != EMPTY) | (z["y"] != EMPTY)))
    same = lambda p: F.size(F.filter(p, lambda z: (z["x"] != EMPTY) & (z["x"] == z["y"])))
    levels = [F.slice(pairs, 1 + i * SUBSETS, SUBSETS) for i in range(len(LEVELS))]
    best = F.array_max(F.array(*[F.when(some(p) >= ENOUGH, same(p) / some(p)) for p in levels]))
    overall = F.when(some(pairs) > 0, same(pairs) / some(pairs)).otherwise(0.0)
    return F.when(F.col(all_a) == F.col(all_b), 1.0).otherwise(F.coalesce(best, overall))


def fingerprint_text(whole: str, subsets: str) -> Column:
    """16 hex digits of the hash of all terms and 8 for each subset."""
    return F.lower(F.concat(F.lpad(F.hex(whole), 16, "0"), F.array_join(F.transform(
        subsets, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    lex = lexicon(docs, low, high, text_col)
    small = lex.count() <= BROADCAST_ROWS
    both = edited_rows(docs, id_col, text_col)
    both = both.withColumns({"a": F.array_distinct(words(F.col("text"))), "b": F.array_distinct(words(F.col("edited")))})
    ways = both.withColumns({"c": F.array_intersect("a", "b"), "d": F.array_except("a", "b"), "e": F.array_except("b", "a")})
    row = [*KEY, "copy"]
    kept = ["id", "n", "copies", *[f"next_{k}" for k in KEY]]
    ways = ways.select(
        *row, *kept, F.sha2("edited", 256).alias("sha"), _whole("a", "text").alias("any_a"), _whole("b", "edited").alias("any_b"),
        F.size("c").alias("nc"), (F.size("c") + F.size("d")).alias("nd"), F.concat("c", "d", "e").alias("every"))
    kept += ["sha", "any_a", "any_b"]
    ways = ways.select(*row, *kept, "nc", "nd", F.posexplode_outer("every").alias("pos", "term"))
    ways = ways.withColumns({"t": F.xxhash64("term"), "side": F.expr("if(pos < nc, 3, if(pos < nd, 1, 2))")})
    lex = lex.withColumn("in_lexicon", F.lit(True))
    hits = ways.join(F.broadcast(lex) if small else lex, "t", "left").where(F.col("in_lexicon") | (F.coalesce("pos", F.lit(0)) == 0))
    got = F.when(F.col("in_lexicon") & F.col("pos").isNotNull(), F.struct("t", "side"))
    found = hits.groupBy(*row).agg(*[F.first(c).alias(c) for c in kept], F.collect_list(got).alias("terms"))
    side = lambda bit: F.array_sort(F.transform(F.filter("terms", lambda x: x["side"].bitwiseAND(bit) != 0), lambda x: x["t"]))
    found = found.withColumns({"a": side(1), "b": side(2)}).drop("terms")
    found = found.withColumns({
        "fa": _hashed("a"), "fb": _hashed("b"),
        "all_a": F.when(F.size("a") > 0, F.xxhash64("a")).otherwise(F.col("any_a")),
        "all_b": F.when(F.size("b") > 0, F.xxhash64("b")).otherwise(F.col("any_b"))})
    found = saved(found.drop("a", "b", "any_a", "any_b"), "fingerprints")
    nexts = found.where("copy = 1").select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("fa").alias("fn"), F.col("all_a").alias("all_n"))
    found = found.join(nexts, [f"next_{k}" for k in KEY])
    return found.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        fingerprint_text("all_a", "fa").alias("fingerprint"), fingerprint_text("all_b", "fb").alias("edited_fingerprint"),
        likeness("fa", "fb", "all_a", "all_b").alias("near_edited"),
        F.when(F.col("copy") < F.col("copies"), 1.0).otherwise(likeness("fa", "fn", "all_a", "all_n")).alias("near_next"))
