"""Product x rule matching without comparing every product with every rule.

A keyword that occurs as a whole word brings its own first word along, so rules
attach to a product through an equality join on that word.  Substrings attach
through a short leading gram in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.functions.text import anchor, any_of, bounded, occurs, pystr, words_of
from shelfcheck.sources.rules import RuleSet, in_scope

SID = "PRODUCT_SET_SID"
GRAM = 4


def prohibited(df: DataFrame, rules: RuleSet, country: str | None) -> DataFrame:
    """Keyword rules with optional categories; the detail lists keywords in rule order."""
    table = rules.get("prohibited").filter(in_scope(country)).select(
        "rule_seq", "keyword", "categories", anchor("keyword").alias("_word")
    )
    words = df.select(
        F.col(SID).alias("sid"), "_name_lower", "_cat_clean", F.explode(words_of("_name_lower")).alias("_word")
    )
    # a keyword of one word is a word of the name
    found = ((F.col("_word") == F.col("keyword")) & (F.col("_word") != "")) | occurs(F.col("_name_lower"), F.col("keyword"))
    hits = words.join(table, "_word").filter(
        ((F.size("categories") == 0) | F.array_contains("categories", F.col("_cat_clean"))) & found
    )
    # Adds a keyword only while the text so far does not contain it.
    listed = F.aggregate(
        F.array_sort(F.collect_set(F.struct("rule_seq", "keyword"))),
        F.lit("Prohibited:"),
        lambda acc, k: F.when(F.contains(acc, k["keyword"]), acc).otherwise(
            F.concat(acc, F.lit(" "), k["keyword"], F.lit(","))
        ),
    )
    return hits.groupBy("sid").agg(F.rtrim(listed, F.lit(",")).alias("detail")).select(
        "sid", F.lit("Prohibited products").alias("flag"), "detail",
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("cv"),
    )


def highlight_prohibited(df: DataFrame, rules: RuleSet, country: str | None) -> DataFrame:
    """Name with the last matching keyword marked, one row per prohibited product."""
    table = rules.get("prohibited").filter(in_scope(country)).select(
        "rule_seq", "keyword", "categories", anchor("keyword").alias("_word")
    )
    words = df.select(
        F.col(SID).alias("sid"), "NAME", "_name_lower", "_cat_clean",
        F.explode(words_of("_name_lower")).alias("_word"),
    )
    hits = words.join(table, "_word").filter(
        F.rlike(F.col("_name_lower"), bounded(F.col("keyword")))
        & ((F.size("categories") == 0) | F.array_contains("categories", F.col("_cat_clean")))
    )
    marked = F.regexp_replace(pystr("NAME"), bounded(F.col("keyword")), F.lit("[!]$0[!]"))
    return hits.groupBy("sid").agg(F.max_by(marked, "rule_seq").alias("NAME"))


def restricted_brands(df: DataFrame, rules: RuleSet, country: str | None) -> DataFrame:
    """Brand rules matched on brand, on the name, or on a spelling variation.

    The last rule that rejects a product decides the text; what it names is the
    latest brand or name match so far, else the first variation match.
    """
    table = rules.get("restricted_brand").filter(in_scope(country))
    longest = F.array_sort(
        "variations",
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    spelled = table.select("*", longest.alias("longest"), F.explode(F.array_union(F.array("brand"), "variations")).alias("_w"))
    keyed = spelled.select(
        anchor("_w").alias("_word"),
        F.struct("rule_seq", "brand", "brand_raw", "sellers", "categories", "longest").alias("r"),
    ).distinct()
    words = df.select(
        F.col(SID).alias("sid"), "_name_lower", "_brand_lower", "_seller_lower", "_cat_clean",
        F.explode(F.array_union(words_of("_name_lower"), words_of("_brand_lower"))).alias("_word"),
    )
    name, brand = F.col("_name_lower"), F.col("_brand_lower")
    spots = lambda text: F.exists("r.longest", lambda v: occurs(text, v))
    pairs = words.join(keyed, "_word").select(
        "sid", "_name_lower", "_brand_lower", "_seller_lower", "_cat_clean", "r",
        ((brand == F.col("r.brand")) | occurs(name, F.col("r.brand"))).alias("main"),
        spots(brand).alias("in_brand"), spots(name).alias("in_name"),
    ).filter(F.col("main") | F.col("in_brand") | F.col("in_name"))
    pairs = pairs.withColumn("var", F.get(
        F.filter("r.longest", lambda v: F.contains(F.when(F.col("in_brand"), brand).otherwise(name), v)), F.lit(0)))
    scoped = (F.size("r.categories") == 0) | F.array_contains("r.categories", F.col("_cat_clean"))
    status = F.when(F.size("r.sellers") > 0, "Seller not in approved list").otherwise("No sellers approved")
    matched = pairs.select(
        "sid",
        F.struct(
            F.col("r.rule_seq").alias("seq"), F.col("main"),
            F.when(F.col("main"), F.col("r.brand_raw"))
            .otherwise(F.concat("r.brand_raw", F.lit(" (as '"), "var", F.lit("')"))).alias("info"),
            (scoped & ~F.array_contains("r.sellers", F.col("_seller_lower"))).alias("rejects"),
            status.alias("status"),
        ).alias("m"),
    )
    # At most one entry per rule that occurs in one product's own name and brand.
    grouped = matched.groupBy("sid").agg(
        F.array_sort(F.collect_set("m")).alias("all"),
        F.max_by("m", F.when(F.col("m.rejects"), F.col("m.seq"))).alias("last"),
    ).filter(F.col("last").isNotNull())
    seen = F.filter("all", lambda m: m["seq"] <= F.col("last.seq"))
    mains = F.filter(seen, lambda m: m["main"])
    info = F.coalesce(F.get(mains, F.size(mains) - 1)["info"], F.get(seen, F.lit(0))["info"])
    return grouped.select(
        "sid", F.lit("Restricted brands").alias("flag"),
        F.concat(F.lit("Restricted Brand: "), info, F.lit(" - "), F.col("last.status")).alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("cv"),
    )


# ---------------------------------------------------------------------------
# Substrings
# ---------------------------------------------------------------------------


def contained(haystacks: DataFrame, hay: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs (haystack row, needle row) where the needle occurs in the haystack.

    Every needle is keyed by its first four characters (all of them when it is
    shorter); a haystack is exploded into its distinct pieces of those lengths.
    """
    keyed = needles.filter(F.length(needle) > 0).withColumn("_gram", F.substring(needle, 1, GRAM))
    lengths = [r[0] for r in keyed.select(F.length("_gram").alias("n")).distinct().collect()]
    if not lengths:
        lengths = [GRAM]
    size = F.length(hay)

    def pieces(n: int):
        starts = F.sequence(F.lit(1), size - (n - 1))
        return F.when(
            size >= n, F.transform(starts, lambda i: F.col(hay).substr(i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*[pieces(n) for n in lengths])))
    return haystacks.withColumn("_gram", F.explode(grams)).join(keyed, "_gram").filter(
        F.contains(F.col(hay), F.col(needle))
    ).drop("_gram")


def ng_books(df: DataFrame, rules: RuleSet) -> DataFrame:
    """The first listed title found inside a name decides who may sell it."""
    titles = rules.get("ng_book")
    name = F.trim(F.lower(pystr("NAME")))
    rows = df.select(F.col(SID).alias("sid"), name.alias("_n"), "_seller_lower")
    rows = rows.filter(F.col("_n").rlike(any_of(rules.values("ng_book"))))
    first = contained(rows, "_n", titles, "title").groupBy("sid").agg(
        F.min_by(F.struct("title", "seller", "_seller_lower"), "rule_seq").alias("b")
    )
    nobody = F.col("b.seller").isNull()
    detail = F.when(
        nobody, F.concat(F.lit("No seller authorised for book: '"), F.substring("b.title", 1, 60), F.lit("'"))
    ).otherwise(
        F.concat(F.lit("Only '"), "b.seller", F.lit("' may sell '"), F.substring("b.title", 1, 40), F.lit("'"))
    )
    return first.filter(nobody | (F.col("b.seller") != F.col("b._seller_lower"))).select(
        "sid", F.lit("NG - Books Seller").alias("flag"), detail.alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("cv"),
    )
