"""Duplicate listings and the spread of flags over equal listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.constants import MATCH_KEY_FLAGS
from shelfcheck.functions.text import group_key, match_key, pystr, squash, strip, word_pattern
from shelfcheck.operators.facts import attach_facts
from shelfcheck.sources.rules import RuleSet

SID = "PRODUCT_SET_SID"
SEQ = "_seq"


def color_key(df: DataFrame, known: list[str]) -> Column:
    """COLOR, else COLOR_FAMILY, unless the name already says a known color."""
    key = F.lit("")
    for c in ("COLOR_FAMILY", "COLOR"):
        if c in df.columns:
            value = F.lower(strip(pystr(c)))
            key = F.when(~value.isin("nan", "none", "", "n/a"), value).otherwise(key)
    pattern = word_pattern(known)
    return F.when(F.col("_name_lower").rlike(pattern), F.lit("")).otherwise(key) if pattern else key


def duplicates(df: DataFrame, rules: RuleSet, by_color: bool = True) -> DataFrame:
    """Every later listing of one seller, brand, normalised name and color.

    The first listing of each group comes from a partial aggregate on a
    fixed-width key and is joined back, so a group may be arbitrarily large.
    """
    rows = df
    if rules.has("code_list"):
        exempt = F.coalesce(F.array_contains("_tags", "list:duplicate_exempt"), F.lit(False))
        rows = attach_facts(df, rules, None, {"_tags"}).filter(~exempt)
    parts = ["_seller_lower", "_brand_lower", squash(F.col("_name_lower"))]
    if by_color:
        parts.append(color_key(df, rules.words("colors")))
    keyed = rows.select(
        F.col(SID).alias("sid"), SEQ, pystr("NAME").alias("name"), group_key(F.concat_ws("|", *parts)).alias("key")
    )
    first = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min(SEQ).alias("_first"), F.min_by("name", SEQ).alias("first_name")
    ).filter(F.col("n") > 1)
    later = keyed.select("sid", SEQ, "key").join(first, "key").filter(F.col(SEQ) > F.col("_first"))
    return later.select(
        "sid", F.lit("Duplicate product").alias("flag"),
        F.concat(F.lit("Duplicate: '"), F.substring("first_name", 1, 40), F.lit("'")).alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("cv"),
    )


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Members of every group of equal (name, brand, seller, color) listings.

    One row per member with its group's first id and size, so that no group has
    to fit into one list.
    """
    keyed = df.select(F.col(SID).alias("sid"), group_keys(df)["_dup_key"].alias("key"))
    groups = keyed.groupBy("key").agg(F.min("sid").alias("group_sid"), F.count("*").alias("members"))
    return keyed.join(groups.filter(F.col("members") > 1), "key").select("group_sid", "sid", "members")


def group_keys(df: DataFrame) -> dict[str, Column]:
    """Key of equal listings and key of equal normalised brand, name and color."""
    has = lambda c: F.col(c) if c in df.columns else F.lit("")
    same = F.concat_ws("\x01", *[F.lower(strip(pystr(has(c)))) for c in ("NAME", "BRAND", "SELLER_NAME", "COLOR")])
    return {
        "_dup_key": group_key(same),
        "_match_key": group_key(match_key(has("BRAND"), has("NAME"), has("COLOR"))),
    }


def spread(hits: DataFrame, keyed: DataFrame, key: str, flags: list[str] | None = None) -> DataFrame:
    """Raise a flag on every listing that shares the key of a flagged one.

    Flagged keys are reduced to one row per key and flag before the join; what
    is joined on the listing side is an id and a fixed-width key.  Adaptive
    execution splits a key held by very many listings, since the flag side has
    few rows per key.
    """
    marked = hits.join(keyed, hits["sid"] == keyed[SID]).select("flag", key)
    if flags is not None:
        marked = marked.filter(F.col("flag").isin(*flags))
    marked = marked.distinct()
    return keyed.select(F.col(SID).alias("sid"), key).join(marked, key).select("sid", "flag")


def expand_duplicates(hits: DataFrame, keyed: DataFrame) -> DataFrame:
    return spread(hits, keyed, "_dup_key")


def expand_match_keys(hits: DataFrame, keyed: DataFrame) -> DataFrame:
    return spread(hits, keyed, "_match_key", MATCH_KEY_FLAGS)
