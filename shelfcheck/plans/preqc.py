"""Pending-listing validation: hits, spread, one decision per product, review actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck import constants as K
from shelfcheck.functions.prices import local_price
from shelfcheck.functions.text import pystr, strip, strip_html_tags
from shelfcheck.operators import duplicates as dup
from shelfcheck.operators import keywords as kw
from shelfcheck.operators.catalog import number_rows
from shelfcheck.operators.checks import checks_for, row_hits
from shelfcheck.registry import registered
from shelfcheck.session import materialize
from shelfcheck.sources.rules import RuleSet, small_table

SID = "PRODUCT_SET_SID"
HIT_COLS = ["sid", "flag", "detail", "reason", "cv"]


def priorities(country: str | None) -> list[str]:
    return K.priority_of(country) + [r.flag for r in registered()]


def flag_hits(df: DataFrame, rules: RuleSet, country: str | None, skip: list[str] = (),
              extra: DataFrame | None = None) -> DataFrame:
    """All hits of all applicable checks.

    ``df`` is a prepared catalog.  Row-local checks share one scan; each
    set-level check adds one branch.  ``extra`` carries hits made elsewhere
    (images, category prediction).
    """
    skipped = set(skip) | set(K.SKIP_CHECKS.get(country, []))
    builders = checks_for(country) + [r.build for r in registered() if r.build]
    parts = [row_hits(df, rules, country, builders, skipped).select(*HIT_COLS)]
    if extra is not None:
        # a category check made elsewhere replaces the one of the row checks
        made = extra.filter(F.col("flag") == "Wrong Category").select("flag").distinct()
        parts[0] = parts[0].join(made, "flag", "left_anti").select(*HIT_COLS)
    sets = [
        ("Restricted brands", "restricted_brand", lambda: kw.restricted_brands(df, rules, country)),
        ("Prohibited products", "prohibited", lambda: kw.prohibited(df, rules, country)),
        ("Duplicate product", None, lambda: dup.duplicates(df, rules)),
    ]
    if country == "NG":
        sets.append(("NG - Books Seller", "ng_book", lambda: kw.ng_books(df, rules)))
    parts += [make() for flag, table, make in sets if flag not in skipped and (table is None or rules.has(table))]
    parts += [r.run(df, rules, country).select(*HIT_COLS) for r in registered() if r.run and r.flag not in skipped]
    if extra is not None:
        parts.append(extra.filter(~F.col("flag").isin(*skipped)).select(*HIT_COLS) if skipped else extra.select(*HIT_COLS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expanded_hits(hits: DataFrame, df: DataFrame) -> DataFrame:
    """Hits plus the same flags on equal listings; only originals carry texts."""
    keyed = df.select(SID, *[c.alias(n) for n, c in dup.group_keys(df).items()])
    spread = dup.expand_duplicates(hits, keyed).unionByName(dup.expand_match_keys(hits, keyed))
    copies = spread.select(
        "sid", "flag", F.lit(None).cast("string").alias("detail"),
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("cv"), F.lit(1).alias("copy"),
    )
    return hits.select(*HIT_COLS, F.lit(0).alias("copy")).unionByName(copies)


def _rank(flag: Column, country: str | None) -> Column:
    order = priorities(country)
    pairs = [x for i, f in enumerate(order) for x in (F.lit(f), F.lit(i))]
    return F.coalesce(F.element_at(F.create_map(*pairs), flag), F.lit(len(order)))


def final_report(df: DataFrame, rules: RuleSet, country: str, skip: list[str] = (),
                 extra: DataFrame | None = None, full_comment: bool = False, carried: list[str] = ()) -> DataFrame:
    """One row per product: the first flag by priority, or Approved.

    Products enter the same aggregate as their hits, as a row that ranks last,
    so no join brings the unflagged ones back.  ``full_comment`` keeps the base
    comment in front of long details too; ``carried`` text columns of the catalog
    follow the report's own.
    """
    hits = materialize(flag_hits(df, rules, country, skip, extra), "hits")
    everything = expanded_hits(hits, df).select(
        "sid",
        F.struct(_rank(F.col("flag"), country).alias("rank"), "copy", "flag", "detail", "reason", "cv").alias("h"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("seller"),
        *[F.lit(None).cast("string").alias(c) for c in carried],
    )
    text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit("")
    none = F.lit(None).cast("string")
    products = df.select(
        F.col(SID).alias("sid"),
        F.struct(
            F.lit(1 << 30).alias("rank"), F.lit(0).alias("copy"), F.lit("").alias("flag"),
            none.alias("detail"), none.alias("reason"), F.lit(False).alias("cv"),
        ).alias("h"),
        text("PARENTSKU").alias("parent"), text("SELLER_NAME").alias("seller"), *[text(c).alias(c) for c in carried],
    )
    first = products.unionByName(everything).groupBy("sid").agg(
        F.min("h").alias("h"), F.max("parent").alias("ParentSKU"), F.max("seller").alias("SellerName"),
        *[F.max(c).alias(c) for c in carried],
    )
    return _comments(first, rules, country, full_comment, carried)


def _comments(first: DataFrame, rules: RuleSet, country: str, full_comment: bool, carried: list[str] = ()) -> DataFrame:
    lang = "fr" if country == "MA" else "en"
    flags = rules.get("flags").select(
        F.col("flag").alias("_flag"), F.col("reason").alias("_reason"),
        F.coalesce(lang, "en").alias("_base"),
    )
    joined = first.join(flags, F.col("h.flag") == F.col("_flag"), "left")
    flag, detail = F.col("h.flag"), F.coalesce(F.col("h.detail"), F.lit(""))
    rejected = flag != ""
    base = F.coalesce("_base", F.concat(F.lit("Flagged by "), flag))
    comment = F.when(detail == "", base)
    if not full_comment:
        comment = comment.when(F.length(detail) > 60, detail)
    comment = comment.otherwise(F.concat(base, F.lit(" ("), detail, F.lit(")")))
    reason = F.coalesce("h.reason", "_reason", F.lit(K.OTHER_REASON))
    wrong_category = (flag == K.POWERBANK_FLAG) & (
        F.contains(F.lower(F.coalesce("h.reason", F.lit(""))), F.lit("wrong category"))
        | (F.contains(F.lower(detail), F.lit("power bank")) & F.contains(F.lower(detail), F.lit("category")))
    )
    return joined.select(
        F.col("sid").alias("ProductSetSid"), "ParentSKU",
        F.when(rejected, "Rejected").otherwise("Approved").alias("Status"),
        F.when(~rejected, "")
        .when(wrong_category, F.coalesce("h.reason", F.lit(K.POWERBANK_CATEGORY_REASON)))
        .otherwise(reason).alias("Reason"),
        F.when(~rejected, "").when(wrong_category, detail).otherwise(comment).alias("Comment"),
        F.when(wrong_category, "Wrong Category").otherwise(flag).alias("FLAG"), "SellerName",
        (F.col("h.cv") & ~wrong_category).alias(K.CV_COL), *carried,
    )


# ---------------------------------------------------------------------------
# Aggregates over the report
# ---------------------------------------------------------------------------


def status_counts(report: DataFrame, df: DataFrame | None = None, common: DataFrame | None = None) -> DataFrame:
    """One row: totals, rejection rate, image flags, multi-country and common ids.

    The three inputs are stacked and counted in one aggregate.
    """
    none, no = F.lit(None).cast("string"), F.lit(False)
    rows = report.select("Status", "FLAG", no.alias("multi"), no.alias("common"))
    if df is not None:
        rows = rows.unionByName(df.select(
            none.alias("Status"), none.alias("FLAG"), F.col("_IS_MULTI_COUNTRY").alias("multi"), no.alias("common")
        ))
    if common is not None:
        rows = rows.unionByName(common.select(
            none.alias("Status"), none.alias("FLAG"), no.alias("multi"), F.lit(True).alias("common")
        ))
    rejected = F.count_if(F.col("Status") == "Rejected")
    return rows.agg(
        F.count("Status").alias("total"), F.count_if(F.col("Status") == "Approved").alias("approved"),
        rejected.alias("rejected"),
        F.coalesce(F.try_divide(rejected * 100.0, F.count("Status")), F.lit(0.0)).alias("rejection_rate"),
        F.count_if(F.col("FLAG").isin(*K.CV_FLAGS)).alias("cv_detected"),
        F.count_if("multi").alias("multi_country"), F.count_if("common").alias("common_skus"),
    )


def flag_counts(report: DataFrame) -> DataFrame:
    return report.filter(F.col("Status") == "Rejected").groupBy("FLAG").agg(F.count("*").alias("n"))


def top_flag(report: DataFrame) -> DataFrame:
    return flag_counts(report).orderBy(F.desc("n"), "FLAG").limit(1)


def seller_summary(report: DataFrame, seller: str = "SellerName") -> DataFrame:
    """Rejected and approved per seller, ranked by rejected.

    The rank needs the per-seller totals in order; those are one row per seller,
    range-partitioned, so the running number is a sum of partition sizes.
    """
    totals = report.groupBy(F.col(seller).alias("SELLER_NAME")).agg(
        F.count_if(F.col("Status") == "Rejected").alias("Rejected"),
        F.count_if(F.col("Status") == "Approved").alias("Approved"),
    )
    return number_rows(totals, [F.desc("Rejected"), F.asc("SELLER_NAME")], "Rank", start=1)


# ---------------------------------------------------------------------------
# Review actions
# ---------------------------------------------------------------------------


def apply_decisions(report: DataFrame, decisions: DataFrame, rules: RuleSet, country: str | None) -> DataFrame:
    """Manual decisions (sid, action, key, seq); the last one per product holds.

    ``reject`` takes a reason key or 'Other Reason (Custom): text'; ``undo``
    approves the product again.
    """
    lang = "fr" if country == "MA" else "en"
    last = decisions.groupBy("sid").agg(F.max_by(F.struct("action", "key"), "seq").alias("d"))
    names = small_table(report.sparkSession, list(K.DECISION_FLAGS.items()), "_key string, _named string")
    flags = rules.get("flags").select(
        F.col("flag").alias("_flag"), F.col("reason").alias("_reason"), F.coalesce(lang, "en").alias("_text")
    )
    key = F.col("d.key")
    custom = key.startswith(K.CUSTOM_PREFIX)
    decided = (
        last.join(names, key == F.col("_key"), "left")
        .withColumn("_to", F.when(custom, K.CUSTOM_FLAG).otherwise(F.coalesce("_named", F.lit(K.CUSTOM_FLAG))))
        .join(flags, F.col("_to") == F.col("_flag"), "left")
        .select(
            F.col("sid").alias("_sid"), (F.col("d.action") == "undo").alias("_undo"), "_to",
            F.when(custom, K.OTHER_REASON).otherwise(F.coalesce("_reason", F.lit(K.OTHER_REASON))).alias("_reason"),
            F.when(custom, F.substring(key, len(K.CUSTOM_PREFIX) + 1, 1 << 30))
            .otherwise(F.coalesce("_text", F.lit("Manual rejection"))).alias("_text"),
        )
    )
    return _override(report, decided)


def _override(report: DataFrame, decided: DataFrame) -> DataFrame:
    """Replace status, reason, comment and flag of the decided products."""
    pick = lambda undo, new, old: F.when(F.col("_undo"), undo).when(~F.col("_undo"), new).otherwise(F.col(old))
    changed = {
        "Status": pick("Approved", F.lit("Rejected"), "Status"),
        "Reason": pick("", F.col("_reason"), "Reason"),
        "Comment": pick("", F.col("_text"), "Comment"),
        "FLAG": pick("Approved by User", F.col("_to"), "FLAG"),
    }
    joined = report.join(decided, report["ProductSetSid"] == decided["_sid"], "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in report.columns])


def reapprove(report: DataFrame, df: DataFrame, rules: RuleSet, country: str, sids: DataFrame,
              flag: str) -> DataFrame:
    """Rerun every check but one on the chosen products; another flag replaces it, none approves."""
    chosen = df.join(sids.select(F.col("sid").alias(SID)).distinct(), SID, "left_semi")
    again = final_report(materialize(chosen, "chosen"), rules, country, skip=[flag])
    decided = again.select(
        F.col("ProductSetSid").alias("_sid"), (F.col("FLAG") == "").alias("_undo"), F.col("FLAG").alias("_to"),
        F.col("Reason").alias("_reason"), F.col("Comment").alias("_text"),
    )
    return _override(report, decided)


def rejection_view(report: DataFrame, df: DataFrame, flag: str, rules: RuleSet, country: str | None) -> DataFrame:
    """Rows of one flag with the display columns, category path and local price."""
    cols = ["PRODUCT_SET_SID", "NAME", "BRAND", "CATEGORY", "COLOR", "GLOBAL_SALE_PRICE", "GLOBAL_PRICE",
            "PARENTSKU", "SELLER_NAME"]
    if flag == "Wrong Variation":
        cols += ["COUNT_VARIATIONS", "LIST_VARIATIONS"]
    sids = report.filter((F.col("Status") == "Rejected") & (F.col("FLAG") == flag)).select(
        F.col("ProductSetSid").alias(SID)
    )
    rows = sids.join(df, SID, "left")
    if rules.has("category"):
        paths = category_paths(rules)
        rows = rows.join(paths, strip(pystr("CATEGORY_CODE")) == paths["_code"], "left").withColumn(
            "CATEGORY", F.coalesce("_full", F.lit(""))
        )
    shown = [c for c in cols if c in df.columns]
    out = rows.select(
        *[strip_html_tags(c).alias(c) if c == "NAME" else F.col(c) for c in shown],
        *([local_price("GLOBAL_SALE_PRICE", "GLOBAL_PRICE", country).alias("Local Price")]
          if {"GLOBAL_PRICE", "GLOBAL_SALE_PRICE"} <= set(shown) else []),
    )
    return out


def category_paths(rules: RuleSet) -> DataFrame:
    return rules.get("category").groupBy(F.col("code").alias("_code")).agg(F.max_by("path", "seq").alias("_full"))


def review_scope(report: DataFrame, df: DataFrame, rules: RuleSet, chosen: DataFrame | None = None) -> DataFrame:
    """Approved products, chosen rejected ones and image-rejected ones, with the grid columns."""
    keep = (F.col("Status") == "Approved") | (
        (F.col("Status") == "Rejected") & F.col("FLAG").isin(*K.REVIEW_IMAGE_FLAGS)
    )
    base = report
    if chosen is not None:
        picked = chosen.select(F.col("sid").alias("_picked")).distinct()
        base = base.join(picked, F.col("ProductSetSid") == F.col("_picked"), "left")
        keep = keep | F.col("_picked").isNotNull()
    grid = [c for c in K.GRID_COLS if c in df.columns]
    extra = [c for c in ("CATEGORY_CODE",) if c in df.columns]
    rows = base.filter(keep).select(F.col("ProductSetSid").alias(SID), "Comment", "FLAG").join(
        df.select(*grid, *extra), SID, "left"
    )
    if rules.has("category") and extra:
        paths = category_paths(rules)
        rows = rows.join(paths, strip(pystr("CATEGORY_CODE")) == paths["_code"], "left").withColumn(
            "CATEGORY", F.coalesce("_full", F.col("CATEGORY_CODE").cast("string"), F.lit(""))
        ).drop("_code", "_full")
    return rows


def review_warnings(report: DataFrame) -> DataFrame:
    """Warning labels read from the comments of image rejections."""
    text = F.lower("Comment")
    labels = F.array_compact(F.array(
        F.when(text.rlike("stretched|tall"), "Tall (Screenshot?)"),
        F.when(text.rlike("stretched|wide"), "Wide Aspect"),
        F.when(text.rlike("blurry|low res|resolution|small"), "Low Resolution"),
    ))
    return report.filter(F.col("FLAG").isin(*K.REVIEW_IMAGE_FLAGS)).select(
        F.col("ProductSetSid").alias("sid"), labels.alias("warnings")
    ).filter(F.size("warnings") > 0)


ISSUE_LABELS = {"low_res": "Low Resolution", "tall": "Tall (Screenshot?)", "wide": "Wide Aspect",
                "broken": "Broken Image"}


def sort_review(df: DataFrame, by: str, warnings: str = "warnings") -> DataFrame:
    """Rows with the chosen issue first, or rows without any issue first; ties by id."""
    issues = F.coalesce(F.col(warnings), F.array().cast("array<string>"))
    if by == "no_issue":
        return df.orderBy((F.size(issues) > 0).cast("int"), SID)
    return df.orderBy((~F.array_contains(issues, ISSUE_LABELS[by])).cast("int"), SID)


def advisories(notes: DataFrame, report: DataFrame, df: DataFrame) -> DataFrame:
    """Image notes (sid, note) for approved products only, with name and seller."""
    approved = report.filter(F.col("Status") == "Approved").select(F.col("ProductSetSid").alias("sid"))
    return notes.join(approved, "sid", "left_semi").join(
        df.select(F.col(SID).alias("sid"), "NAME", "SELLER_NAME"), "sid"
    ).select(F.col("sid").alias(SID), "NAME", "SELLER_NAME", "note")


