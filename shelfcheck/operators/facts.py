"""Attach what the rule tables say about a row's category code, seller and brand.

Three left joins replace some thirty membership tests.  No side is hinted: the
rule tables carry their size, so Spark broadcasts them below
``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges above it, where
adaptive execution splits hot codes, sellers and brands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.functions.prices import fmt, rate_of
from shelfcheck.functions.text import clean_category_code, path_segments, strip
from shelfcheck.sources.rules import RuleSet, ancestors, in_scope


def tagged(tag: str) -> Column:
    """Is the row's category code in a list ('list:x') or program ('program:x')?"""
    return F.coalesce(F.array_contains("_tags", tag), F.lit(False))


def approved(program: str) -> Column:
    """Is the row's seller on the approved list of a program?"""
    return F.coalesce(F.array_contains("_programs", program), F.lit(False))


def code_facts(rules: RuleSet) -> DataFrame:
    parts = []
    none = F.lit(None)
    if rules.has("code_list"):
        parts.append(rules.get("code_list").select(
            clean_category_code("code").alias("code"),
            F.concat(F.lit("list:"), F.col("list_name")).alias("tag"),
            none.cast("string").alias("path"), none.cast("long").alias("seq"),
        ))
    if rules.has("program_category"):
        parts.append(rules.get("program_category").select(
            F.col("code"), F.concat(F.lit("program:"), F.col("program")).alias("tag"),
            none.cast("string").alias("path"), none.cast("long").alias("seq"),
        ))
    if rules.has("category"):
        parts.append(rules.get("category").select("code", none.cast("string").alias("tag"), "path", "seq"))
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(F.col("code").alias("_code")).agg(
        F.collect_set("tag").alias("_tags"), F.max_by("path", "seq").alias("_path")
    )


def cap_facts(rules: RuleSet, country: str | None) -> DataFrame:
    """Price cap per category code: its own, else the nearest ancestor's, else the level-1 cap."""
    category = rules.get("category").filter(F.col("path").isNotNull()).groupBy("code").agg(
        F.max_by("path", "seq").alias("path"), F.min("seq").alias("seq")
    )
    caps = rules.get("price_cap").filter(F.col("country") == F.lit(country)).select("code", "cap_local")
    rate = rate_of(country)
    exact = caps.select(
        F.col("code").alias("_code"), F.lit(0).alias("rank"), F.lit(0).alias("near"), F.lit(0).cast("long").alias("seq"),
        F.col("cap_local").alias("cap"), F.concat(F.lit("exact code "), F.col("code")).alias("source"),
    )
    holders = category.join(caps, "code").select(
        strip("path").alias("ancestor"), F.col("seq"), F.col("cap_local").alias("cap")
    )
    above = ancestors(category).join(holders, "ancestor").select(
        F.col("code").alias("_code"), F.lit(1).alias("rank"), (-F.col("depth")).alias("near"), "seq", "cap",
        F.concat(F.lit("ancestor '"), F.col("ancestor"), F.lit("'")).alias("source"),
    )
    first = category.select("code", strip(F.element_at(F.split("path", ">"), 1)).alias("level1"))
    level1 = first.join(rules.get("level1_cap"), "level1").select(
        F.col("code").alias("_code"), F.lit(2).alias("rank"), F.lit(0).alias("near"), F.lit(0).cast("long").alias("seq"),
        (F.col("cap_usd") * F.lit(rate)).alias("cap"),
        F.concat(
            F.lit("USD fallback for '"), F.col("level1"), F.lit("' ($"), fmt(F.col("cap_usd"), 0),
            F.lit(f" × {rate} rate)"),
        ).alias("source"),
    )
    order = F.struct("rank", "near", "seq")
    return exact.unionByName(above).unionByName(level1).groupBy("_code").agg(
        F.min_by("cap", order).alias("_cap"), F.min_by("source", order).alias("_cap_source")
    )


def name_start(c: Column) -> Column:
    """Lower name with quotes, dots and dashes as spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"['.\-]", " "), r"(?U)\s+", " "))


START_ANCHOR = r"(?U)^[^\p{L}\p{N}]*[\p{L}\p{N}]*"


def brand_starts(rules: RuleSet) -> DataFrame:
    """Known brands grouped by how a name has to start, longest first."""
    brand = F.lower(strip("word"))
    return (
        rules.get("word_list").filter(F.col("list_name") == "known_brands")
        .select(brand.alias("brand")).distinct().filter("brand != ''")
        .select("brand", name_start(F.col("brand")).alias("clean"))
        .filter("clean != ''")
        .groupBy(F.regexp_extract("clean", START_ANCHOR, 0).alias("_start"))
        .agg(F.array_sort(F.collect_list(
            F.struct((-F.length("brand")).alias("neg"), F.col("brand"), F.col("clean"))
        )).alias("_starts"))
    )


FACT_TYPES = {
    "_tags": "array<string>",
    "_path": "string",
    "_cap": "double",
    "_cap_source": "string",
    "_programs": "array<string>",
    "_min_price": "double",
    "_tv_sellers": "array<string>",
    "_rice": "struct<sellers:array<string>,categories:array<string>>",
    "_starts": "array<struct<neg:int,brand:string,clean:string>>",
}


def attach_facts(df: DataFrame, rules: RuleSet, country: str | None, needed: set[str] | None = None) -> DataFrame:
    """Left-join the needed facts that exist; absent rule tables give NULL columns."""
    needed = set(FACT_TYPES) if needed is None else needed
    out = df
    if needed & {"_tags", "_path"}:
        tags = code_facts(rules)
        if tags is not None:
            out = out.join(tags, out["_cat_clean"] == tags["_code"], "left").drop("_code")
    if needed & {"_cap", "_cap_source"} and (rules.has("price_cap") or rules.has("category")):
        caps = cap_facts(rules, country)
        out = out.join(caps, out["_cat_clean"] == caps["_code"], "left").drop("_code")
    if "_programs" in needed and rules.has("seller_allow"):
        sellers = rules.get("seller_allow").filter(in_scope(country)).groupBy(
            F.col("seller").alias("_s")
        ).agg(F.collect_set("program").alias("_programs"))
        out = out.join(sellers, out["_seller_lower"] == sellers["_s"], "left").drop("_s")
    if "_min_price" in needed and rules.has("fake_price"):
        fake = rules.get("fake_price").filter(in_scope(country)).groupBy(
            F.col("brand").alias("_b"), F.col("category").alias("_c")
        ).agg(F.max("min_price").alias("_min_price"))
        same = (out["_brand_lower"] == fake["_b"]) & (out["_cat_clean"] == fake["_c"])
        out = out.join(fake, same, "left").drop("_b", "_c")
    if "_tv_sellers" in needed and rules.has("ng_tv"):
        tvs = rules.get("ng_tv").groupBy(F.col("brand").alias("_b")).agg(
            F.collect_set("seller").alias("_tv_sellers")
        )
        out = out.join(tvs, out["_brand_lower"] == tvs["_b"], "left").drop("_b")
    if "_rice" in needed and rules.has("ng_rice"):
        rice = rules.get("ng_rice").select(
            F.col("brand").alias("_b"), F.struct("sellers", "categories").alias("_rice")
        )
        out = out.join(rice, out["_brand_lower"] == rice["_b"], "left").drop("_b")
    if "_starts" in needed and rules.has("word_list"):
        starts = brand_starts(rules)
        out = out.withColumn("_start", F.regexp_extract(name_start(F.col("NAME")), START_ANCHOR, 0))
        out = out.join(starts, "_start", "left").drop("_start")
    missing = {
        c: F.lit(None).cast(t) for c, t in FACT_TYPES.items() if c in needed and c not in out.columns
    }
    return out.withColumns(missing) if missing else out


__all__ = ["attach_facts", "approved", "cap_facts", "code_facts", "path_segments", "tagged"]
