"""Registered queries: name -> (Spark function, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck_queries import rules as R
from shelfcheck_queries import sql as S
from shelfcheck.adapter import catalog
from shelfcheck.operators import catalog as cat
from shelfcheck.operators import checks as C
from shelfcheck.operators import duplicates as dup
from shelfcheck.operators import keywords as kw
from shelfcheck.plans import preqc
from shelfcheck.session import materialize, materialize_by, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def prepared(spark: SparkSession, sf_dir: str, country: str | None = None, columns: list[str] | None = None,
             core: list[str] | None = None) -> DataFrame:
    return cat.prepare_catalog(catalog(spark, sf_dir), country, columns=columns, core=core)


_TABLES: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries start from, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = materialize(make(), name)
    return _TABLES[key]


def stored(spark, sf_dir, country="KE") -> DataFrame:
    """Prepared catalog of one country as a table."""
    return once(spark, sf_dir, f"catalog-{country}", lambda: prepared(spark, sf_dir, country))


def stored_report(spark, sf_dir, country="KE") -> DataFrame:
    """Decision report of one country as a table."""
    return carried_report(spark, sf_dir, country).drop("CATEGORY")


def carried_report(spark, sf_dir, country="KE") -> DataFrame:
    """Decision report of one country with the category of each product, so that no reader joins it."""
    return once(spark, sf_dir, f"report-{country}", lambda: preqc.final_report(
        stored(spark, sf_dir, country), R.rule_set(spark, sf_dir), country, carried=["CATEGORY"]))


# ---------------------------------------------------------------------------
# Preparation
# ---------------------------------------------------------------------------

PREPARED_SQL = """
SELECT sid AS "PRODUCT_SET_SID", PARENTSKU, NAME, BRAND, CATEGORY, CATEGORY_CODE, SELLER_NAME, ACTIVE_STATUS_COUNTRY,
  price AS "GLOBAL_PRICE", sale AS "GLOBAL_SALE_PRICE", COLOR, COLOR_FAMILY, PRODUCT_WARRANTY, WARRANTY_DURATION,
  COUNT_VARIATIONS, MAIN_IMAGE, cat AS cat_clean, is_multi FROM p"""
PREPARED_COLS = [
    "PRODUCT_SET_SID", "PARENTSKU", "NAME", "BRAND", "CATEGORY", "CATEGORY_CODE", "SELLER_NAME",
    "ACTIVE_STATUS_COUNTRY", "GLOBAL_PRICE", "GLOBAL_SALE_PRICE", "COLOR", "COLOR_FAMILY", "PRODUCT_WARRANTY",
    "WARRANTY_DURATION", "COUNT_VARIATIONS", "MAIN_IMAGE",
]


def _prepared_out(df: DataFrame) -> DataFrame:
    return df.select(*PREPARED_COLS, F.col("_cat_clean").alias("cat_clean"), F.col("_IS_MULTI_COUNTRY").alias("is_multi"))


@query("prepare_catalog", f"WITH {S.prepared()} {PREPARED_SQL}")
def prepare_catalog(spark, sf_dir):
    return _prepared_out(prepared(spark, sf_dir))


@query("prepare_catalog_ng", f"WITH {S.prepared('NG')} {PREPARED_SQL}")
def prepare_catalog_ng(spark, sf_dir):
    return _prepared_out(prepared(spark, sf_dir, "NG"))


@query("fill_metadata", f"""WITH {S.raw()}, {S.FILLED}
SELECT sid AS "PRODUCT_SET_SID", NAME, COLOR_FAMILY, PRODUCT_WARRANTY, WARRANTY_DURATION, COUNT_VARIATIONS FROM filled""")
def fill_metadata(spark, sf_dir):
    cols = ["COLOR_FAMILY", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "COUNT_VARIATIONS"]
    rows = catalog(spark, sf_dir).select("_seq", "PRODUCT_SET_SID", "NAME", *cols)
    return cat.fill_metadata(rows, cols).drop("_seq")


@query("filter_country", f"""WITH {S.raw()}
SELECT sid AS "PRODUCT_SET_SID", NAME, country AS "ACTIVE_STATUS_COUNTRY", country IN ('MULTIPLE', 'MULTI') AS is_multi
FROM (SELECT *, regexp_replace(upper(trim(ACTIVE_STATUS_COUNTRY)), '^[A-Z]+-', '') AS country FROM raw)
WHERE country IN ('NG', 'MULTIPLE', 'MULTI')""")
def filter_country(spark, sf_dir):
    rows = cat.filter_country(catalog(spark, sf_dir), "NG")
    return rows.select("PRODUCT_SET_SID", "NAME", "ACTIVE_STATUS_COUNTRY", F.col("_IS_MULTI_COUNTRY").alias("is_multi"))


@query("detected_countries", f"""WITH {S.raw()}
SELECT DISTINCT country AS code, coalesce(CASE country WHEN 'KE' THEN 'Kenya' WHEN 'UG' THEN 'Uganda' WHEN 'NG' THEN 'Nigeria'
  WHEN 'GH' THEN 'Ghana' WHEN 'MA' THEN 'Morocco' END, '''' || country || '''') AS name
FROM (SELECT regexp_replace(upper(trim(ACTIVE_STATUS_COUNTRY)), '^[A-Z]+-', '') AS country FROM raw)""")
def detected_countries(spark, sf_dir):
    return cat.detected_countries(catalog(spark, sf_dir))


@query("common_sids", f"""WITH {S.raw()}
SELECT sid AS "PRODUCT_SET_SID" FROM (SELECT DISTINCT sid, _seq IS NOT NULL, substr(COALESCE(COLOR, 'none'), 1, 3) AS f FROM raw)
GROUP BY sid HAVING count(*) = (SELECT count(DISTINCT substr(COALESCE(COLOR, 'none'), 1, 3)) FROM raw)""")
def common_sids(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("_file", F.substring(F.coalesce("COLOR", F.lit("none")), 1, 3))
    return cat.common_sids(rows, "_file")


@query("union_distinct_files", f"""WITH {S.raw()}
SELECT sid AS "PRODUCT_SET_SID", NAME, COLOR, CAST(NULL AS VARCHAR) AS "COLOR_FAMILY" FROM raw WHERE COLOR = 'Red'
UNION ALL SELECT sid, NAME, CAST(NULL AS VARCHAR), COLOR_FAMILY FROM raw WHERE COLOR IS NULL
UNION ALL SELECT sid, NAME, COLOR, COLOR_FAMILY FROM raw WHERE COLOR <> 'Red'""")
def union_distinct_files(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    one = rows.filter("COLOR = 'Red'").select("PRODUCT_SET_SID", "NAME", "COLOR")
    two = rows.filter("COLOR IS NULL").select("PRODUCT_SET_SID", "NAME", "COLOR_FAMILY")
    three = rows.filter("COLOR <> 'Red'").select("NAME", "COLOR_FAMILY", "COLOR", "PRODUCT_SET_SID")
    return one.unionByName(two, allowMissingColumns=True).unionByName(three)


@query("search_catalog", f"""WITH {S.prepared()}
SELECT sid AS "PRODUCT_SET_SID", NAME, BRAND, SELLER_NAME FROM p
WHERE contains(name_l, 'brand#1') OR contains(brand_l, 'brand#1') OR contains(seller_l, 'brand#1')""")
def search_catalog(spark, sf_dir):
    rows = prepared(spark, sf_dir).select("PRODUCT_SET_SID", "NAME", "BRAND", "SELLER_NAME")
    return cat.search(rows, "Brand#1", ["NAME", "BRAND", "SELLER_NAME"])


@query("page_of_catalog", f"""WITH {S.prepared()}
SELECT sid AS "PRODUCT_SET_SID", NAME FROM p ORDER BY sid LIMIT 50 OFFSET 100""")
def page_of_catalog(spark, sf_dir):
    rows = prepared(spark, sf_dir).select("PRODUCT_SET_SID", "NAME")
    return cat.page(rows, 2, 50, ["PRODUCT_SET_SID"])


# ---------------------------------------------------------------------------
# Checks
# ---------------------------------------------------------------------------

HIT = ["sid", "flag", "detail", "reason"]

ROW_QUERIES = {
    "chk_fake_price": ("Suspected Fake product", C.fake_price),
    "chk_refurb_seller": ("Seller Not approved to sell Refurb", C.refurb),
    "chk_warranty": ("Product Warranty", C.warranty),
    "chk_books_seller": ("Seller Approve to sell books", C.books_seller),
    "chk_perfume_seller": ("Seller Approved to Sell Perfume", C.perfume_seller),
    "chk_tester": ("Perfume Tester", C.perfume_tester),
    "chk_sneakers": ("Counterfeit Sneakers", C.sneakers),
    "chk_jerseys": ("Suspected counterfeit Jerseys", C.jerseys),
    "chk_unnecessary_words": ("Unnecessary words in NAME", C.unnecessary_words),
    "chk_single_word": ("Single-word NAME", C.single_word_name),
    "chk_generic_brand": ("Generic BRAND Issues", C.generic_brand),
    "chk_fashion_brand": ("Fashion brand issues", C.fashion_brand),
    "chk_brand_in_name": ("BRAND name repeated in NAME", C.brand_in_name),
    "chk_wrong_variation": ("Wrong Variation", C.wrong_variation),
    "chk_genuine_brand": ("Generic branded products with genuine brands", C.genuine_brand),
    "chk_missing_color": ("Missing COLOR", C.missing_color),
    "chk_weight": ("Missing Weight/Volume", C.weight_in_name),
    "chk_smartphone": ("Incomplete Smartphone Name", C.smartphone_name),
    "chk_category_max_price": ("Category Max Price Exceeded", C.max_price),
}


def _row_query(builder):
    def run(spark, sf_dir):
        rows = prepared(spark, sf_dir)
        return C.row_hits(rows, R.rule_set(spark, sf_dir), "KE", [builder]).select(*HIT)

    return run


for _name, (_flag, _builder) in ROW_QUERIES.items():
    query(_name, S.single_check(_flag))(_row_query(_builder))


@query("chk_discount", S.many_checks(["Discount too high"], "KE"))
def chk_discount(spark, sf_dir):
    rows = C.row_hits(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "KE", [C.discount], ["Suspicious Discount"])
    return rows.select(*HIT)


@query("chk_suspicious_discount", S.many_checks(["Suspicious Discount"], "KE"))
def chk_suspicious_discount(spark, sf_dir):
    rows = C.row_hits(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "KE", [C.discount], ["Discount too high"])
    return rows.select(*HIT)


@query("chk_restricted_brand", S.single_check("Restricted brands"))
def chk_restricted_brand(spark, sf_dir):
    return kw.restricted_brands(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "KE").select(*HIT)


@query("chk_prohibited", S.single_check("Prohibited products"))
def chk_prohibited(spark, sf_dir):
    return kw.prohibited(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "KE").select(*HIT)


@query("highlight_prohibited", f"""WITH {S.prepared()}
SELECT sid, max_by(regexp_replace(NAME, '(?i)\\b(' || kw || ')\\b', '[!]\\1[!]', 'g'), seq) AS "NAME"
FROM p JOIN {S.values(R.PROHIBITED, "seq, kw, cats")}
  ON {S.hit('name_l', 'kw')} AND (len(cats) = 0 OR list_contains(cats, cat)) GROUP BY sid""")
def highlight_prohibited(spark, sf_dir):
    return kw.highlight_prohibited(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "KE")


@query("highlight_unnecessary", f"""WITH {S.prepared()}
SELECT sid, regexp_replace(NAME, '{S.word(R.WORDS["unnecessary"])}', '[*]\\1[*]', 'g') AS "NAME" FROM p
WHERE regexp_matches(name_l, '{S.word(R.WORDS["unnecessary"])}')""")
def highlight_unnecessary(spark, sf_dir):
    from shelfcheck.functions.text import highlight, word_pattern

    pattern = word_pattern(R.WORDS["unnecessary"])
    rows = prepared(spark, sf_dir).filter(F.col("_name_lower").rlike(pattern))
    return rows.select(F.col("PRODUCT_SET_SID").alias("sid"), highlight("NAME", pattern, "[*]").alias("NAME"))


@query("chk_duplicates", S.single_check("Duplicate product"))
def chk_duplicates(spark, sf_dir):
    return dup.duplicates(prepared(spark, sf_dir), R.rule_set(spark, sf_dir)).select(*HIT)


NG_FLAGS = ["NG - Gift Card Seller", "NG - HP Toners Seller", "NG - Apple Seller", "NG - Xmas Tree Seller",
            "NG - TV Brand Seller", "NG - Rice Brand Seller", "NG - Books Seller"]
# Toner and Apple rules name fixed brands; two catalog brands are read as those.
AS_NG_BRANDS = "CASE BRAND WHEN 'Brand#10' THEN 'HP' WHEN 'Brand#11' THEN 'Apple' ELSE BRAND END"


@query("chk_country_ng", S.many_checks(NG_FLAGS, "NG").replace(
    "split_part(trim(CATEGORY_CODE), '.', 1) AS cat,", "split_part(trim(CATEGORY_CODE), '.', 1) AS cat,", 1
).replace("trim(lower(BRAND)) AS brand_l", f"trim(lower({AS_NG_BRANDS})) AS brand_l", 1))
def chk_country_ng(spark, sf_dir):
    base = catalog(spark, sf_dir).withColumn("BRAND", F.expr(AS_NG_BRANDS))
    rows = materialize(cat.prepare_catalog(base, columns=[]), "prepared")
    rules = R.rule_set(spark, sf_dir)
    own = C.row_hits(rows, rules, "NG", [C.ng_seller_lists, C.ng_xmas, C.ng_tv, C.ng_rice])
    return own.select(*HIT).unionByName(kw.ng_books(rows, rules).select(*HIT))


AS_POWERBANK = "regexp_replace(regexp_replace(NAME, 'gizmo', 'Power Bank'), '([0-9]+)gb', '$1000mAh')"


@query("chk_powerbank", S.many_checks(["Powerbank Not Authorized"], "KE").replace(
    "FROM filled WHERE TRUE", """FROM (SELECT * REPLACE (regexp_replace(regexp_replace(NAME, 'gizmo', 'Power Bank', 'g'),
      '([0-9]+)gb', '\\1000mAh', 'g') AS NAME) FROM filled) WHERE TRUE""", 1))
def chk_powerbank(spark, sf_dir):
    base = catalog(spark, sf_dir).withColumn("NAME", F.regexp_replace(
        F.regexp_replace("NAME", "gizmo", "Power Bank"), "([0-9]+)gb", "$1\\000mAh"))
    return C.row_hits(cat.prepare_catalog(base), R.rule_set(spark, sf_dir), "KE", [C.powerbank]).select(*HIT)


@query("chk_country_ma", S.single_check("MA - Marque Interdite", "MA"))
def chk_country_ma(spark, sf_dir):
    return C.row_hits(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "MA", [C.ma_brands]).select(*HIT)


@query("chk_miscellaneous", f"""WITH {S.prepared()}
SELECT sid, 'Wrong Category' AS flag, 'Category contains ''Miscellaneous''' AS detail, CAST(NULL AS VARCHAR) AS reason FROM p
WHERE regexp_matches(replace(CATEGORY, 'gizmo', 'Miscellaneous'), '(?i)miscellaneous')""")
def chk_miscellaneous(spark, sf_dir):
    base = catalog(spark, sf_dir).withColumn("CATEGORY", F.replace("CATEGORY", F.lit("gizmo"), F.lit("Miscellaneous")))
    return C.row_hits(cat.prepare_catalog(base), R.rule_set(spark, sf_dir), None, [C.miscellaneous]).select(*HIT)


@query("all_row_hits", S.many_checks([f for f, _ in ROW_QUERIES.values()] + ["Discount too high", "Suspicious Discount"], "KE"))
def all_row_hits(spark, sf_dir):
    builders = [b for _, b in ROW_QUERIES.values()] + [C.discount]
    return C.row_hits(prepared(spark, sf_dir), R.rule_set(spark, sf_dir), "KE", builders).select(*HIT)


# ---------------------------------------------------------------------------
# Report
# ---------------------------------------------------------------------------


def report(spark, sf_dir, country="KE"):
    rows = prepared(spark, sf_dir, country)
    return preqc.final_report(rows, R.rule_set(spark, sf_dir), country)


REPORT_COLS = "ProductSetSid, ParentSKU, Status, Reason, Comment, FLAG, SellerName, CV_Detected"

for _c in ("KE", "NG", "MA"):
    query("final_report" + ("" if _c == "KE" else f"_{_c.lower()}"), f"{S.report_ctes(_c)} SELECT {REPORT_COLS} FROM report")(
        lambda spark, sf_dir, c=_c: report(spark, sf_dir, c)
    )


def _with_report(country: str, body: str) -> str:
    return f"{S.report_ctes(country)} {body}"


@query("report_status_counts", _with_report("NG", """
SELECT count(*) AS total, count(*) FILTER (WHERE Status = 'Approved') AS approved,
  count(*) FILTER (WHERE Status = 'Rejected') AS rejected,
  count(*) FILTER (WHERE Status = 'Rejected') * 100.0::DOUBLE / count(*) AS rejection_rate,
  count(*) FILTER (WHERE FLAG LIKE 'Image %') AS cv_detected,
  (SELECT count(*) FILTER (WHERE is_multi) FROM p) AS multi_country, 0 AS common_skus FROM report"""))
def report_status_counts(spark, sf_dir):
    return preqc.status_counts(stored_report(spark, sf_dir, "NG"), stored(spark, sf_dir, "NG"))


@query("report_flag_counts", _with_report("KE", "SELECT FLAG, count(*) AS n FROM report WHERE Status = 'Rejected' GROUP BY FLAG"))
def report_flag_counts(spark, sf_dir):
    return preqc.flag_counts(stored_report(spark, sf_dir))


@query("report_top_flag", _with_report("KE", """
SELECT FLAG, count(*) AS n FROM report WHERE Status = 'Rejected' GROUP BY FLAG ORDER BY n DESC, FLAG LIMIT 1"""))
def report_top_flag(spark, sf_dir):
    return preqc.top_flag(stored_report(spark, sf_dir))


@query("seller_summary", _with_report("KE", """
SELECT *, row_number() OVER (ORDER BY Rejected DESC, SELLER_NAME) AS Rank FROM (
  SELECT SellerName AS "SELLER_NAME", count(*) FILTER (WHERE Status = 'Rejected') AS Rejected,
    count(*) FILTER (WHERE Status = 'Approved') AS Approved FROM report GROUP BY 1)"""))
def seller_summary(spark, sf_dir):
    return preqc.seller_summary(stored_report(spark, sf_dir))


@query("split_parts", f"""WITH {S.prepared()}
SELECT sid AS "PRODUCT_SET_SID", NAME, CAST(floor((row_number() OVER (ORDER BY sid) - 1) / 9998) + 1 AS BIGINT) AS part FROM p""")
def split_parts(spark, sf_dir):
    from shelfcheck.sources.sinks import split_parts as split

    return split(prepared(spark, sf_dir).select("PRODUCT_SET_SID", "NAME"), [F.asc("PRODUCT_SET_SID")])


@query("duplicate_groups", f"""WITH {S.prepared()}
SELECT * FROM (
SELECT min(sid) OVER g AS group_sid, sid, count(*) OVER g AS members FROM p
WINDOW g AS (PARTITION BY lower(trim(NAME)), lower(trim(BRAND)), lower(trim(SELLER_NAME)), lower(trim(coalesce(COLOR, 'nan'))))
) WHERE members > 1""")
def duplicate_groups(spark, sf_dir):
    return dup.duplicate_groups(prepared(spark, sf_dir))


@query("export_report_rejected", _with_report("KE", """
SELECT ProductSetSid, ParentSKU, Status, Reason, Comment, FLAG, SellerName FROM report WHERE Status = 'Rejected'"""))
def export_report_rejected(spark, sf_dir):
    from shelfcheck.sources.sinks import export_report

    return export_report(stored_report(spark, sf_dir), "rejected")


@query("export_full", _with_report("KE", """
SELECT sid AS "PRODUCT_SET_SID", ACTIVE_STATUS_COUNTRY, NAME, BRAND, CATEGORY, CATEGORY_CODE,
  coalesce(c.path, '') AS "FULL_CATEGORY_PATH", COLOR, COLOR_FAMILY, MAIN_IMAGE, CAST(NULL AS VARCHAR) AS "VARIATION",
  p.PARENTSKU, SELLER_NAME, CAST(NULL AS VARCHAR) AS "SELLER_SKU", price AS "GLOBAL_PRICE", sale AS "GLOBAL_SALE_PRICE",
  CAST(NULL AS VARCHAR) AS "TAX_CLASS", r.FLAG, CAST(NULL AS VARCHAR) AS "LISTING_STATUS", PRODUCT_WARRANTY, WARRANTY_DURATION,
  CAST(NULL AS VARCHAR) AS "WARRANTY_ADDRESS", CAST(NULL AS VARCHAR) AS "WARRANTY_TYPE", COUNT_VARIATIONS,
  CAST(NULL AS VARCHAR) AS "LIST_VARIATIONS", r.Status, r.Reason, r.Comment, r.SellerName
FROM p LEFT JOIN report r ON r.ProductSetSid = p.sid LEFT JOIN category c ON c.code = p.CATEGORY_CODE"""))
def export_full(spark, sf_dir):
    from shelfcheck.sources.sinks import export_full as full

    return full(stored(spark, sf_dir), stored_report(spark, sf_dir), R.rule_set(spark, sf_dir))


# Review decisions derived from the report: every product id decides what happens to it.
DECISION_SQL = """
decisions AS (
  SELECT ProductSetSid AS sid, 'reject' AS action, CASE hash_mod % 4 WHEN 0 THEN 'REJECT_COLOR' WHEN 1 THEN 'REJECT_WRONG_CAT'
    WHEN 2 THEN 'Other Reason (Custom): looks wrong' ELSE 'REJECT_UNKNOWN' END AS key, 1 AS seq
  FROM (SELECT *, CAST(regexp_extract(ProductSetSid, 'P(\\d+)', 1) AS BIGINT) AS hash_mod FROM report) WHERE hash_mod % 3 = 0
  UNION ALL
  SELECT ProductSetSid, 'undo', '', 2 FROM report WHERE CAST(regexp_extract(ProductSetSid, 'P(\\d+)', 1) AS BIGINT) % 5 = 0
)"""


@query("apply_decisions", f"""{S.report_ctes("KE")}, {DECISION_SQL},
last AS (SELECT sid, max_by(action, seq) AS action, max_by(key, seq) AS key FROM decisions GROUP BY sid)
SELECT ProductSetSid, ParentSKU,
  CASE action WHEN 'undo' THEN 'Approved' WHEN 'reject' THEN 'Rejected' ELSE Status END AS Status,
  CASE WHEN action = 'undo' THEN '' WHEN action IS NULL THEN r.Reason WHEN key = 'REJECT_COLOR' THEN '1000005 - Kindly confirm the actual product colour'
    WHEN key = 'REJECT_WRONG_CAT' THEN '1000004 - Wrong Category' ELSE '1000007 - Other Reason' END AS Reason,
  CASE WHEN action = 'undo' THEN '' WHEN action IS NULL THEN Comment WHEN key = 'REJECT_COLOR' THEN 'Product color must be mentioned in title/color tab.'
    WHEN key = 'REJECT_WRONG_CAT' THEN 'Assigned to Wrong Category. Please use correct category.'
    WHEN key LIKE 'Other%' THEN 'looks wrong' ELSE 'Manual rejection' END AS Comment,
  CASE WHEN action = 'undo' THEN 'Approved by User' WHEN action IS NULL THEN FLAG WHEN key = 'REJECT_COLOR' THEN 'Missing COLOR'
    WHEN key = 'REJECT_WRONG_CAT' THEN 'Wrong Category' ELSE 'Other Reason (Custom)' END AS FLAG,
  SellerName, CV_Detected
FROM report r LEFT JOIN last ON last.sid = r.ProductSetSid""")
def apply_decisions(spark, sf_dir):
    done = stored_report(spark, sf_dir)
    number = F.regexp_extract("ProductSetSid", r"P(\d+)", 1).cast("long")
    key = (
        F.when(number % 4 == 0, "REJECT_COLOR").when(number % 4 == 1, "REJECT_WRONG_CAT")
        .when(number % 4 == 2, "Other Reason (Custom): looks wrong").otherwise("REJECT_UNKNOWN")
    )
    reject = done.filter(number % 3 == 0).select(
        F.col("ProductSetSid").alias("sid"), F.lit("reject").alias("action"), key.alias("key"), F.lit(1).alias("seq"))
    undo = done.filter(number % 5 == 0).select(
        F.col("ProductSetSid").alias("sid"), F.lit("undo").alias("action"), F.lit("").alias("key"), F.lit(2).alias("seq"))
    return preqc.apply_decisions(done, reject.unionByName(undo), R.rule_set(spark, sf_dir), "KE")


REAPPROVED = "Unnecessary words in NAME"


@query("reapprove", f"""WITH before AS MATERIALIZED ({S.report_ctes("KE")} SELECT * FROM report),
again AS MATERIALIZED ({S.report_ctes("KE", (REAPPROVED,), f"sid IN (SELECT ProductSetSid FROM before WHERE FLAG = '{REAPPROVED}')")} SELECT * FROM report)
SELECT b.ProductSetSid, b.ParentSKU,
  CASE WHEN a.ProductSetSid IS NULL THEN b.Status WHEN a.FLAG = '' THEN 'Approved' ELSE 'Rejected' END AS Status,
  coalesce(a.Reason, b.Reason) AS Reason, coalesce(a.Comment, b.Comment) AS Comment,
  CASE WHEN a.ProductSetSid IS NULL THEN b.FLAG WHEN a.FLAG = '' THEN 'Approved by User' ELSE a.FLAG END AS FLAG,
  b.SellerName, b.CV_Detected
FROM before b LEFT JOIN again a USING (ProductSetSid)""")
def reapprove(spark, sf_dir):
    rows, rules, done = stored(spark, sf_dir), R.rule_set(spark, sf_dir), stored_report(spark, sf_dir)
    chosen = done.filter(F.col("FLAG") == REAPPROVED).select(F.col("ProductSetSid").alias("sid"))
    return preqc.reapprove(done, rows, rules, "KE", chosen, REAPPROVED)


@query("rejection_view", _with_report("KE", """
SELECT p.sid AS "PRODUCT_SET_SID", NAME, BRAND, coalesce(c.path, '') AS "CATEGORY", COLOR, sale AS "GLOBAL_SALE_PRICE",
  price AS "GLOBAL_PRICE", p.PARENTSKU, SELLER_NAME, COUNT_VARIATIONS,
  CASE WHEN coalesce(sale, price) > 0 THEN 'KSh ' || format('{:,.0f}', coalesce(sale, price) * 128.0) ELSE '' END AS "Local Price"
FROM report r JOIN p ON p.sid = r.ProductSetSid LEFT JOIN category c ON c.code = p.CATEGORY_CODE
WHERE r.FLAG = 'Wrong Variation'"""))
def rejection_view(spark, sf_dir):
    rows, rules = stored(spark, sf_dir), R.rule_set(spark, sf_dir)
    return preqc.rejection_view(stored_report(spark, sf_dir), rows, "Wrong Variation", rules, "KE")


@query("review_scope", _with_report("KE", """
SELECT r.ProductSetSid AS "PRODUCT_SET_SID", Comment, FLAG, NAME, BRAND, coalesce(c.path, p.CATEGORY_CODE) AS "CATEGORY", SELLER_NAME,
  MAIN_IMAGE, sale AS "GLOBAL_SALE_PRICE", price AS "GLOBAL_PRICE", COLOR, CATEGORY_CODE
FROM report r JOIN p ON p.sid = r.ProductSetSid LEFT JOIN category c ON c.code = p.CATEGORY_CODE
WHERE Status = 'Approved' OR FLAG = 'Wrong Variation'"""))
def review_scope(spark, sf_dir):
    rows, rules, done = stored(spark, sf_dir), R.rule_set(spark, sf_dir), stored_report(spark, sf_dir)
    chosen = done.filter("FLAG = 'Wrong Variation'").select(F.col("ProductSetSid").alias("sid"))
    return preqc.review_scope(done, rows, rules, chosen)


# ---------------------------------------------------------------------------
# Live listings
# ---------------------------------------------------------------------------

from shelfcheck.adapter import table  # noqa: E402
from shelfcheck.functions import text as T  # noqa: E402
from shelfcheck.operators import postqc as P  # noqa: E402
from shelfcheck.plans import quality as Q  # noqa: E402

LIVE_SQL = f"""{S.prepared(None, True)}, {S.CATEGORY},
rates AS (SELECT user_id, count(*) AS reviews, max(value) AS top FROM events GROUP BY user_id),
live AS (
  SELECT p.*, CASE WHEN partkey % 97 = 0 THEN price * 600 WHEN partkey % 19 = 0 THEN price * 12 END AS old_price,
    top / 100 AS RATING, CASE WHEN partkey % 4 = 0 THEN 0 ELSE reviews END AS REVIEW_COUNT,
    CASE WHEN partkey % 3 = 0 THEN CAST(partkey % 100 AS VARCHAR) || '%' END AS DISCOUNT, partkey % 9 AS images,
    CASE WHEN partkey % 6 = 0 THEN 'x,JMALL' ELSE 'plain' END AS TAGS
  FROM p LEFT JOIN rates ON user_id = partkey % 150
)"""


def with_descriptions(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """Joins the descriptions last, so that no later join of the listings carries the texts through a shuffle."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("DESCRIPTION"))
    rows = rows.withColumn("_doc", F.regexp_extract("PRODUCT_SET_SID", r"P(\d+)", 1).cast("long"))
    return rows.join(docs, F.col("_doc") == F.col("doc_id"), "left").drop("_doc", "doc_id")


def described(spark, sf_dir) -> DataFrame:
    """Prepared catalog with descriptions; the text belongs to the model, so it joins after the de-duplication."""
    return with_descriptions(spark, sf_dir, prepared(spark, sf_dir))


def live(spark, sf_dir) -> DataFrame:
    """Prepared catalog with ratings, old prices and descriptions."""
    return with_descriptions(spark, sf_dir, rated(spark, sf_dir))


def rated(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    rows = prepared(spark, sf_dir) if rows is None else rows
    key = F.regexp_extract("PRODUCT_SET_SID", r"P(\d+)", 1).cast("long")
    # a table, so that its size is known and the listings are not dealt by the few keys that meet it
    rates = materialize(table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("_reviews"), F.max("value").alias("_top")), "rates")
    rows = rows.withColumn("_key", key)
    return rows.join(rates, F.col("_key") % 150 == F.col("user_id"), "left").withColumns({
        "OLD_PRICE": F.when(F.col("_key") % 97 == 0, F.col("GLOBAL_PRICE") * 600)
        .when(F.col("_key") % 19 == 0, F.col("GLOBAL_PRICE") * 12),
        "RATING": F.col("_top") / 100,
        "REVIEW_COUNT": F.when(F.col("_key") % 4 == 0, F.lit(0)).otherwise(F.col("_reviews")),
        "DISCOUNT": F.when(F.col("_key") % 3 == 0, F.concat((F.col("_key") % 100).cast("string"), F.lit("%"))),
        "No. of Images": F.col("_key") % 9,
        "TAGS": F.when(F.col("_key") % 6 == 0, "x,JMALL").otherwise("plain"),
    }).drop("user_id", "_reviews", "_top", "_key")


def _live_check(builders):
    def run(spark, sf_dir):
        return C.row_hits(live(spark, sf_dir), R.rule_set(spark, sf_dir), None, builders).select("sid", "flag", "detail")

    return run


query("chk_live_prices_and_ratings", f"""WITH {LIVE_SQL}
SELECT sid, 'Fake discount' AS flag, 'Old price ' || format('{{:,.0f}}', old_price) || ' is ' || format('{{:,.0f}}', old_price / price)
  || '× current ' || format('{{:,.0f}}', price) AS detail FROM live WHERE price > 0 AND old_price > price * 10
UNION ALL
SELECT sid, 'Low rating', 'Rating ' || CAST(round_even(RATING, 1) AS VARCHAR) || ' < 3.0' FROM live WHERE RATING < 3.0
UNION ALL SELECT sid, 'No ratings', 'No customer ratings' FROM live WHERE RATING IS NULL""")(
    _live_check([P.fake_discount, P.low_rating, P.no_ratings]))

query("chk_live_content", f"""WITH {LIVE_SQL}
SELECT sid, 'Few Images (<5)' AS flag, 'Product has only ' || images || ' image(s), minimum recommended is 5' AS detail FROM live WHERE images < 5
UNION ALL SELECT sid, 'Empty Description', 'Product has no description' FROM live WHERE coalesce(trim(DESCRIPTION), '') IN ('', 'nan', 'None')
UNION ALL SELECT sid, 'Thin Description', 'Product description is too short' FROM live
  WHERE length(DESCRIPTION) < 100 AND trim(DESCRIPTION) NOT IN ('', 'nan', 'None')
UNION ALL SELECT sid, 'Missing Images in Desc', 'Product description does not contain any images' FROM live
  WHERE DESCRIPTION IS NOT NULL AND NOT regexp_matches(DESCRIPTION, '(?i)<img')""")(
    _live_check([P.few_images, P.description_checks]))

query("chk_brands_by_path", f"""WITH {S.prepared()}, {S.CATEGORY}
SELECT sid, 'Generic BRAND Issues' AS flag, CAST(NULL AS VARCHAR) AS detail FROM p
WHERE lower(BRAND) = 'generic' AND ({S.in_codes('fashion')} OR regexp_matches(replace(CATEGORY, 'gizmo', 'fashion'), '(?i)\\bfashion\\b'))
UNION ALL SELECT sid, 'Fashion brand issues', NULL FROM p
WHERE brand_l = 'fashion' AND NOT {S.in_codes('fashion')} AND NOT regexp_matches(replace(CATEGORY, 'gizmo', 'fashion'), '(?i)\\bfashion\\b')""")(
    lambda spark, sf_dir: C.row_hits(
        cat.prepare_catalog(catalog(spark, sf_dir).withColumn("CATEGORY", F.replace("CATEGORY", F.lit("gizmo"), F.lit("fashion")))),
        R.rule_set(spark, sf_dir), None, [C.generic_brand_by_path, C.fashion_brand_by_path]).select("sid", "flag", "detail"))


@query("chk_repeated_description", f"""WITH {S.prepared(None, True)}
SELECT sid, 'Repeated Description' AS flag, 'Description appears in multiple products' AS detail FROM
(SELECT sid, count(*) OVER (PARTITION BY DESCRIPTION) AS n FROM p WHERE trim(DESCRIPTION) <> '') WHERE n > 1""")
def chk_repeated_description(spark, sf_dir):
    rows = described(spark, sf_dir)
    return P.repeated_description(rows).select("sid", "flag", "detail")


@query("live_advisories", f"""WITH {LIVE_SQL}
SELECT sid AS "PRODUCT_SET_SID",
  coalesce(price > 0 AND sale > 0 AND price > sale * 500, FALSE) AS corrupted,
  coalesce(NOT coalesce(price > 0 AND sale > 0 AND price > sale * 500, FALSE) AND
    abs(CASE WHEN price > 0 AND sale < price THEN (price - sale) / price * 100 END - TRY_CAST(replace(DISCOUNT, '%', '') AS DOUBLE)) > 5, FALSE) AS mismatch,
  brand_l <> '' AND (length(name_l) - length(replace(name_l, brand_l, ''))) / length(brand_l) >= 2 AS brand_twice,
  coalesce(RATING > 0, FALSE) AND (REVIEW_COUNT IS NULL OR REVIEW_COUNT = 0) AS no_reviews
FROM live""")
def live_advisories(spark, sf_dir):
    return P.advisory_columns(live(spark, sf_dir)).select(
        "PRODUCT_SET_SID", F.col("_OLD_PRICE_CORRUPTED").alias("corrupted"), F.col("_DISCOUNT_MISMATCH").alias("mismatch"),
        F.col("_BRAND_IN_TITLE").alias("brand_twice"), F.col("_RATING_NO_REVIEWS").alias("no_reviews"))


@query("derive_discount", f"""WITH {LIVE_SQL}
SELECT sid AS "PRODUCT_SET_SID", coalesce(DISCOUNT, CASE WHEN price > 0 AND sale < price
  THEN CAST(CAST(round_even((price - sale) / price * 100, 0) AS BIGINT) AS VARCHAR) || '%' END, '') AS "DISCOUNT",
  CASE WHEN TAGS LIKE '%JMALL%' THEN 'Yes' ELSE 'No' END AS official FROM live""")
def derive_discount(spark, sf_dir):
    rows = P.derive_official_store(P.fill_discount(live(spark, sf_dir)))
    return rows.select("PRODUCT_SET_SID", "DISCOUNT", F.col("IS_OFFICIAL_STORE").alias("official"))


@query("fill_summary", f"""WITH {S.raw()}, {S.FILLED},
a AS (SELECT count(COLOR_FAMILY) AS cf, count(PRODUCT_WARRANTY) AS pw, count(WARRANTY_DURATION) AS wd, count(COUNT_VARIATIONS) AS cv FROM raw),
b AS (SELECT count(COLOR_FAMILY) AS cf, count(PRODUCT_WARRANTY) AS pw, count(WARRANTY_DURATION) AS wd, count(COUNT_VARIATIONS) AS cv FROM filled)
SELECT "column", before, after, after - before AS filled FROM (
SELECT 'COLOR_FAMILY' AS "column", a.cf AS before, b.cf AS after FROM a, b UNION ALL SELECT 'PRODUCT_WARRANTY', a.pw, b.pw FROM a, b
UNION ALL SELECT 'WARRANTY_DURATION', a.wd, b.wd FROM a, b UNION ALL SELECT 'COUNT_VARIATIONS', a.cv, b.cv FROM a, b)""")
def fill_summary(spark, sf_dir):
    cols = ["COLOR_FAMILY", "PRODUCT_WARRANTY", "WARRANTY_DURATION", "COUNT_VARIATIONS"]
    rows = catalog(spark, sf_dir).select("_seq", "PRODUCT_SET_SID", *cols)
    return P.fill_summary(rows, cat.fill_metadata(rows, cols), cols)


@query("fill_rate", f"""WITH {S.raw()}
SELECT 'COLOR' AS "column", count(COLOR)::DOUBLE / count(*) AS fill_rate FROM raw
UNION ALL SELECT 'COLOR_FAMILY', count(COLOR_FAMILY)::DOUBLE / count(*) FROM raw
UNION ALL SELECT 'GLOBAL_PRICE', count(price)::DOUBLE / count(*) FROM raw""")
def fill_rate(spark, sf_dir):
    return P.fill_rate(catalog(spark, sf_dir), ["COLOR", "COLOR_FAMILY", "GLOBAL_PRICE", "ABSENT"])


@query("resolve_category_code", f"""WITH {S.raw()}, {S.CATEGORY},
names AS (SELECT lower(trim(split_part(path, ' > ', 3))) AS name, max_by(code, code) AS code FROM cat GROUP BY 1),
named AS (SELECT sid, CATEGORY || CASE CAST(regexp_extract(sid, 'P(\\d+)', 1) AS BIGINT) % 7 WHEN 0 THEN ' Extra!' WHEN 1 THEN ' > other' ELSE '' END AS CATEGORY FROM raw)
SELECT sid AS "PRODUCT_SET_SID", CATEGORY, coalesce((SELECT code FROM names WHERE name = split_part(CATEGORY, ' > ', 3)),
  (SELECT code FROM names WHERE name = split_part(CATEGORY, ' > ', 2)), (SELECT code FROM names WHERE name = lower(split_part(CATEGORY, ' > ', 1))), regexp_replace(lower(string_split(CATEGORY, ' > ')[-1]), '[^a-z0-9]', '_', 'g')) AS "CATEGORY_CODE"
FROM named""")
def resolve_category_code(spark, sf_dir):
    from shelfcheck.adapter import categories

    names = categories(spark, sf_dir).groupBy(
        F.lower(F.split_part("path", F.lit(" > "), F.lit(3))).alias("name")).agg(F.max("code").alias("code"))
    kind = F.regexp_extract("PRODUCT_SET_SID", r"P(\d+)", 1).cast("long") % 7
    tail = F.when(kind == 0, " Extra!").when(kind == 1, " > other").otherwise("")
    rows = catalog(spark, sf_dir).select("PRODUCT_SET_SID", F.concat("CATEGORY", tail).alias("CATEGORY"))
    return P.resolve_category_code(rows, names)


@query("keep_first", f"""WITH {S.raw()}
SELECT sid AS "PRODUCT_SET_SID", NAME, price AS "GLOBAL_PRICE" FROM raw QUALIFY row_number() OVER (PARTITION BY sid ORDER BY _seq) = 1""")
def keep_first(spark, sf_dir):
    return cat.keep_first(catalog(spark, sf_dir)).select("PRODUCT_SET_SID", "NAME", "GLOBAL_PRICE")


def issue_sql(country: str) -> str:
    checks = S.check_sql(country)
    checks["Blacklisted Keyword"] = checks["Unnecessary words in NAME"].replace(
        S.word(R.WORDS["unnecessary"]), S.word(R.WORDS["blacklisted"]))
    checks["Fashion brand issues"] = f"""SELECT sid, 'Brand ''Fashion'' used outside Fashion category: ' || CATEGORY_CODE AS detail, NULL AS reason
      FROM p WHERE brand_l = 'fashion' AND NOT {S.in_codes('fashion')}"""
    live_ = {
        "Fake discount": """SELECT sid, 'Old price ' || format('{:,.0f}', old_price) || ' is ' || format('{:,.0f}', old_price / price)
           || '× current ' || format('{:,.0f}', price) AS detail FROM live WHERE price > 0 AND old_price > price * 10""",
        "Repeated Description": """SELECT sid, 'Description appears in multiple products' AS detail FROM (SELECT sid, count(*) OVER
           (PARTITION BY DESCRIPTION) AS n FROM p WHERE trim(DESCRIPTION) <> '') WHERE n > 1""",
        "Few Images (<5)": "SELECT sid, 'Product has only ' || images || ' image(s), minimum recommended is 5' AS detail FROM live WHERE images < 5",
        "Empty Description": "SELECT sid, 'Product has no description' AS detail FROM live WHERE coalesce(trim(DESCRIPTION), '') IN ('', 'nan', 'None')",
        "Thin Description": """SELECT sid, 'Product description is too short' AS detail FROM live WHERE length(DESCRIPTION) < 100
           AND trim(DESCRIPTION) NOT IN ('', 'nan', 'None')""",
        "Missing Images in Desc": """SELECT sid, 'Product description does not contain any images' AS detail FROM live
           WHERE DESCRIPTION IS NOT NULL AND NOT regexp_matches(DESCRIPTION, '(?i)<img')""",
    }
    parts = []
    for i, (flag, severity, column, message) in enumerate(Q.PLAN):
        body = checks.get(flag) or live_.get(flag)
        if body is None:
            continue
        rank = Q.SEVERITY_ORDER.index(severity)
        parts.append(f"SELECT sid, {rank} AS rank, {i} AS ord, {S.lit(column)} AS col, "
                     f"coalesce(nullif(trim(detail), ''), {S.lit(message or column)}) AS msg FROM ({body})")
    return f"""WITH {LIVE_SQL}, {S.RESTRICTED}, issues AS (
SELECT * FROM ({" UNION ALL ".join(parts)}) QUALIFY row_number() OVER (PARTITION BY sid, col, substr(msg, 1, 80) ORDER BY ord) = 1)"""


def quality_sql(country: str) -> str:
    flags = ", ".join(f"CASE WHEN bool_or(col = {S.lit(c)}) THEN 'YES' ELSE 'NO' END AS {chr(34)}{c}{chr(34)}" for c in Q.FLAG_COLS)
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n{i}" for i in range(4))
    tags = "['critical', 'high', 'medium', 'low'][rank + 1]"
    return f"""{issue_sql(country)}, agg AS (
SELECT live.sid, {counts}, coalesce(string_agg('[' || {tags} || '] ' || msg, ' | ' ORDER BY rank, ord), '') AS top, {flags}
FROM live LEFT JOIN issues USING (sid) GROUP BY live.sid),
quality AS (SELECT sid AS "SKU", NAME AS "Name", BRAND AS "Brand", CATEGORY AS "Category", price AS "Price", old_price AS "Old Price",
  DISCOUNT AS "Discount", RATING AS "Rating", '' AS "Total Ratings", SELLER_NAME AS "Seller", 'No' AS "Shop Express", 'No' AS "Shop Global",
  MAIN_IMAGE AS "Image URL", '' AS "Product URL", 'In Stock' AS "Stock", '' AS "Tags", '{country}' AS "Country",
  greatest(0, 100 - n0 * 25 - n1 * 12 - n2 * 6 - n3 * 2) AS "Quality Score", n0 AS "Critical Issues", n1 AS "High Issues", n2 AS "Medium Issues",
  n3 AS "Low Issues", n0 + n1 + n2 + n3 AS "Total Issues", top AS "Top Issues", images AS "No. of Images",
  {", ".join(f'{chr(34)}{c}{chr(34)}' for c in Q.FLAG_COLS)} FROM live JOIN agg USING (sid))"""


def stored_quality(spark, sf_dir):
    """Scores, counts and YES columns of the report: what its readers read."""
    kept = ["SKU", "Quality Score", "Critical Issues", "Total Issues", *Q.FLAG_COLS]
    return once(spark, sf_dir, "quality", lambda: quality(spark, sf_dir).select(*[F.col(f"`{c}`") for c in kept]))


#: What the quality report and its checks read.
QUALITY_COLS = ["NAME", "BRAND", "CATEGORY", "CATEGORY_CODE", "SELLER_NAME", "GLOBAL_PRICE", "GLOBAL_SALE_PRICE", "MAIN_IMAGE", "COUNT_VARIATIONS"]


def quality_listings(spark, sf_dir) -> DataFrame:
    """Prepared catalog as the quality report reads it, a table dealt by product id."""
    key = (spark.sparkContext.applicationId, sf_dir, "quality-listings")
    if key not in _TABLES:
        rows = prepared(spark, sf_dir, columns=[], core=QUALITY_COLS).select("PRODUCT_SET_SID", *QUALITY_COLS)
        _TABLES[key] = materialize_by(rows, "PRODUCT_SET_SID", "listings")
    return _TABLES[key]


def quality(spark, sf_dir, country="KE"):
    rows = rated(spark, sf_dir, quality_listings(spark, sf_dir)).drop("TAGS")
    return Q.quality_report(rows, R.rule_set(spark, sf_dir), country, describe=lambda df: with_descriptions(spark, sf_dir, df))


@query("quality_report", f"{quality_sql('KE')} SELECT * FROM quality")
def quality_report(spark, sf_dir):
    return quality(spark, sf_dir)


@query("quality_report_ng", f"{quality_sql('NG')} SELECT * FROM quality")
def quality_report_ng(spark, sf_dir):
    return quality(spark, sf_dir, "NG")


@query("quality_kpis", f"""{quality_sql('KE')}
SELECT avg("Quality Score") AS mean_score, count(*) FILTER (WHERE "Total Issues" > 0) AS with_issues,
  count(*) FILTER (WHERE "Critical Issues" > 0) AS critical, count(*) FILTER (WHERE "Total Issues" = 0) AS clean,
  count(*) FILTER (WHERE "Total Issues" > 0) * 100.0::DOUBLE / count(*) AS issue_rate FROM quality""")
def quality_kpis(spark, sf_dir):
    return Q.quality_kpis(stored_quality(spark, sf_dir))


@query("quality_flag_counts", f"""{quality_sql('KE')} SELECT * FROM ({" UNION ALL ".join(
    f'SELECT {S.lit(c)} AS "column", count(*) FILTER (WHERE "{c}" = {S.lit("YES")}) AS products FROM quality' for c in Q.FLAG_COLS)}) WHERE products > 0""")
def quality_flag_counts(spark, sf_dir):
    return Q.yes_counts(stored_quality(spark, sf_dir))


@query("filter_quality", f"""{quality_sql('KE')} SELECT "SKU", "Quality Score" FROM quality
WHERE "Critical Issues" > 0 AND "Quality Score" BETWEEN 20 AND 70 AND "Naming Issue" = 'YES'""")
def filter_quality(spark, sf_dir):
    return Q.filter_quality(stored_quality(spark, sf_dir), "critical", "Naming Issue", 20, 70).select("SKU", "Quality Score")


@query("export_post_qc", _with_report("KE", """
SELECT p.sid AS "PRODUCT_SET_SID", NAME, BRAND, CASE WHEN Status = 'Approved' THEN 'ok' ELSE FLAG END AS "FINAL_FLAG",
  CASE WHEN Status = 'Approved' THEN 'ok' ELSE Comment END AS "FLAG_REASON" FROM p JOIN report r ON r.ProductSetSid = p.sid"""))
def export_post_qc(spark, sf_dir):
    from shelfcheck.sources.sinks import export_post_qc as export

    rows = stored(spark, sf_dir)
    return export(rows.select("PRODUCT_SET_SID", "NAME", "BRAND", "_name_lower"), stored_report(spark, sf_dir))


# ---------------------------------------------------------------------------
# Weekly analytics
# ---------------------------------------------------------------------------

from shelfcheck.plans import weekly as W  # noqa: E402
from shelfcheck.sources.files import export_file_columns  # noqa: E402

WEEK_SQL = f"""{S.report_ctes("KE")},
week AS (SELECT r.*, p.CATEGORY, DATE '2024-01-01' + CAST(partkey % 7 AS INTEGER) AS "Date", 'Kenya' AS "Country"
  FROM report r JOIN p ON p.sid = r.ProductSetSid),
days AS (SELECT *, dayname("Date") AS "Day" FROM week)"""


def week(spark, sf_dir) -> DataFrame:
    done = carried_report(spark, sf_dir)
    number = F.regexp_extract("ProductSetSid", r"P(\d+)", 1).cast("long") % 7
    name = F.concat(F.lit("KE_export_"), F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int")).cast("string"), F.lit(".csv"))
    return export_file_columns(done, name)


@query("export_file_columns", f"""{WEEK_SQL}
SELECT ProductSetSid, "Date", "Day", "Country", weekofyear("Date") AS "Week" FROM days""")
def export_columns(spark, sf_dir):
    return week(spark, sf_dir).select("ProductSetSid", "Date", "Day", "Country", "Week")


@query("weekly_daily", f"""{WEEK_SQL}
SELECT v.d AS "Day", count(*) FILTER (WHERE Status = 'Approved') AS "Approved", count(*) FILTER (WHERE Status = 'Rejected') AS "Rejected",
  count(Status) AS "Daily Total" FROM {S.values([(d,) for d in W.WEEK_DAYS], "d")} LEFT JOIN days ON d = "Day" GROUP BY 1
UNION ALL SELECT 'Weekly Total', count(*) FILTER (WHERE Status = 'Approved'), count(*) FILTER (WHERE Status = 'Rejected'), count(*) FROM days""")
def weekly_daily(spark, sf_dir):
    return W.daily_summary(week(spark, sf_dir))


@query("weekly_sellers", f"""{WEEK_SQL}
SELECT SellerName AS "Seller", count(*) FILTER (WHERE Status = 'Approved') AS "Approved", count(*) FILTER (WHERE Status = 'Rejected') AS "Rejected",
  count(*) AS "Total Submitted", round_even(count(*) FILTER (WHERE Status = 'Rejected') / count(*) * 100, 1) AS "Rejection Rate (%)"
FROM days GROUP BY 1""")
def weekly_sellers(spark, sf_dir):
    return W.seller_stats(week(spark, sf_dir))


@query("weekly_trend", f"""{WEEK_SQL} SELECT "Date", Status, count(*) AS "Count" FROM days GROUP BY 1, 2""")
def weekly_trend(spark, sf_dir):
    return W.trend(week(spark, sf_dir))


@query("weekly_reasons", f"""{WEEK_SQL} SELECT FLAG AS "Reason", count(*) AS "Rejected Count" FROM days WHERE Status = 'Rejected' GROUP BY 1""")
def weekly_reasons(spark, sf_dir):
    return W.reason_counts(week(spark, sf_dir))


@query("weekly_top_categories", f"""{WEEK_SQL}
SELECT CATEGORY AS "Category", count(*) AS "Rejected Count" FROM days WHERE Status = 'Rejected' GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5""")
def weekly_top_categories(spark, sf_dir):
    return W.top_rejected(W.category_counts(week(spark, sf_dir)), "Category")


@query("weekly_top_sellers", f"""{WEEK_SQL}
SELECT SellerName AS "Seller", count(*) FILTER (WHERE Status = 'Approved') AS "Approved", count(*) FILTER (WHERE Status = 'Rejected') AS "Rejected",
  count(*) AS "Total Submitted", round_even(count(*) FILTER (WHERE Status = 'Rejected') / count(*) * 100, 1) AS "Rejection Rate (%)"
FROM days GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5""")
def weekly_top_sellers(spark, sf_dir):
    return W.top_sellers(W.seller_stats(week(spark, sf_dir)))


@query("weekly_insights", f"""{WEEK_SQL},
reasons AS (SELECT FLAG, count(*) AS n FROM days WHERE Status = 'Rejected' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
worst AS (SELECT SellerName, count(*) AS n FROM days WHERE Status = 'Rejected' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
busy AS (SELECT "Day", count(*) AS n FROM days GROUP BY 1, isodow("Date") ORDER BY 2 DESC, isodow("Date") LIMIT 1)
SELECT count(*) AS total, count(*) FILTER (WHERE Status = 'Approved') AS approved, count(*) FILTER (WHERE Status = 'Rejected') AS rejected,
  count(*) FILTER (WHERE Status = 'Rejected') * 100.0::DOUBLE / count(*) AS rejection_rate, 'action required' AS verdict,
  (SELECT "Day" FROM busy) AS busiest_day, (SELECT FLAG FROM reasons) AS top_reason, (SELECT n FROM reasons) AS top_reason_count,
  (SELECT n FROM reasons) * 100.0::DOUBLE / count(*) FILTER (WHERE Status = 'Rejected') AS top_reason_share,
  (SELECT SellerName FROM worst) AS worst_seller, (SELECT n FROM worst) AS worst_seller_rejected FROM days""")
def weekly_insights(spark, sf_dir):
    return W.insights(week(spark, sf_dir))


@query("weekly_cover", f"""{WEEK_SQL}
SELECT unnest(['Country / Region', 'Reporting Week', 'Total Files/Parts Merged', 'Total Products Processed', 'Total Approved', 'Total Rejected',
  'Overall Rejection Rate']) AS "Metric", unnest(['Kenya', 'Week 1', CAST(count(DISTINCT "Date") AS VARCHAR), CAST(count(*) AS VARCHAR),
  CAST(count(*) FILTER (WHERE Status = 'Approved') AS VARCHAR), CAST(count(*) FILTER (WHERE Status = 'Rejected') AS VARCHAR),
  format('{{:,.1f}}', count(*) FILTER (WHERE Status = 'Rejected') * 100.0::DOUBLE / count(*)) || '%']) AS "Value" FROM days""")
def weekly_cover(spark, sf_dir):
    return W.cover_metrics(week(spark, sf_dir))


# ---------------------------------------------------------------------------
# Lookup
# ---------------------------------------------------------------------------

from shelfcheck.operators import lookup as L  # noqa: E402

MASTER_SQL = """
master AS (
SELECT 'S' || p_partkey AS sku, CAST(p_partkey AS VARCHAR) AS num, 'M' || (p_partkey % 400) AS model_code, p_name AS product_name,
  p_brand AS brand_name, split_part(p_name, ' ', 1) AS color, CAST(p_size % 9 AS VARCHAR) AS size, p_type AS type,
  split_part(p_name, ' ', 2) AS family, CASE WHEN p_partkey % 3 = 0 THEN 'no size' END AS extra, p_partkey FROM part
)"""


def master(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("S"), key.cast("string")).alias("sku_num_sku_r3"),
        F.concat(F.lit("M"), (key % 400).cast("string")).alias("model_code"),
        F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand_name"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"), (F.col("p_size") % 9).cast("string").alias("size"),
        F.col("p_type").alias("type"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("family"),
    )


def terms(spark, sf_dir) -> DataFrame:
    """Search terms from the order lines: ids, with some that do not exist."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.concat(F.lit(" S"), (F.col("l_partkey") * F.when(F.col("l_linenumber") == 7, 100000).otherwise(1)).cast("string")).alias("term"))


TERMS_SQL = """terms AS (SELECT DISTINCT 'S' || (l_partkey * CASE WHEN l_linenumber = 7 THEN 100000 ELSE 1 END) AS term FROM lineitem)"""


@query("lookup_rows", f"""WITH {MASTER_SQL}, {TERMS_SQL}
SELECT term, sku AS "sku_num_sku_r3", product_name FROM terms JOIN master ON sku = term""")
def lookup_rows(spark, sf_dir):
    return L.lookup_terms(master(spark, sf_dir), terms(spark, sf_dir)).select("term", "sku_num_sku_r3", "product_name")


@query("lookup_unmatched", f"WITH {MASTER_SQL}, {TERMS_SQL} SELECT term FROM terms WHERE term NOT IN (SELECT sku FROM master)")
def lookup_unmatched(spark, sf_dir):
    return L.unmatched_terms(master(spark, sf_dir), terms(spark, sf_dir))


@query("lookup_by_name", f"""WITH {MASTER_SQL}, t AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT term, sku AS "sku_num_sku_r3" FROM t JOIN master ON contains(lower(product_name), lower(term)) OR sku = term""")
def lookup_by_name(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_name").alias("term")).unionByName(part.select(F.col("p_type").alias("term")))
    return L.lookup_terms(master(spark, sf_dir), words, by_name=True).select("term", "sku_num_sku_r3")


@query("variation_kind", f"""WITH {MASTER_SQL}, kinds AS (
SELECT model_code, CASE WHEN count(DISTINCT color) > 1 AND count(DISTINCT size) > 1 THEN 'color,size' WHEN count(DISTINCT color) > 1 THEN 'color'
  ELSE 'size' END AS variation FROM master GROUP BY 1)
SELECT sku AS "sku_num_sku_r3", variation FROM master JOIN kinds USING (model_code)""")
def variation_kind(spark, sf_dir):
    rows = master(spark, sf_dir)
    return L.with_variation(rows, rows).select("sku_num_sku_r3", "variation")


BRAND_ENTRIES = [(1, "7 - Brand#1 Gold", "brand#1 gold"), (2, "8 - Brand#2", "brand#2"), (3, "9 - Brand", "brand#2 old"),
                 (4, "10 - d#3", "d#3"), (5, "11 - Super Brand#14", "super brand#14"), (6, "12 - #1", "#1")]


@query("brand_match", f"""WITH m AS (SELECT DISTINCT p_brand AS raw FROM part), c AS (
SELECT raw, entry, seq, CASE WHEN name = lower(raw) THEN 1 WHEN contains(name, lower(raw)) THEN 2 ELSE 3 END AS stage
FROM m JOIN {S.values(BRAND_ENTRIES, "seq, entry, name")} ON contains(name, lower(raw)) OR contains(lower(raw), name))
SELECT m.raw AS brand_name, coalesce((SELECT entry FROM c WHERE c.raw = m.raw ORDER BY stage, seq LIMIT 1), m.raw) AS brand FROM m""")
def brand_match(spark, sf_dir):
    from shelfcheck.sources.rules import small_table

    brands = small_table(spark, BRAND_ENTRIES, "seq long, brand_entry string, brand_name_lower string")
    return L.match_brands(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand_name")), brands)


REFERENCE_SQL = f"""{S.CATEGORY}, ref AS (
SELECT CAST(code AS BIGINT) AS seq, 'E' || code AS export, split_part(path, ' > ', 3) AS name,
  list_distinct(regexp_extract_all(lower(path), '([a-z]+)', 1)) AS tokens, CASE WHEN path LIKE 'LARGE%' THEN 3 ELSE 2 END AS depth FROM cat)"""


def reference(spark, sf_dir) -> DataFrame:
    from shelfcheck.adapter import categories

    return categories(spark, sf_dir).select(
        "seq", F.concat(F.lit("E"), F.col("code")).alias("export_category"),
        F.split_part("path", F.lit(" > "), F.lit(3)).alias("category_name_lower"),
        F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit("([a-z]+)"), F.lit(1))).alias("path_tokens"),
        F.when(F.col("path").startswith("LARGE"), 3).otherwise(2).alias("depth"), "path",
    )


@query("keyword_category", f"""WITH {MASTER_SQL}, {REFERENCE_SQL},
q AS (SELECT DISTINCT lower(concat_ws(' ', family, type, brand_name, color, size, product_name)) AS query FROM master)
SELECT query, rank, export AS export_category, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS rank FROM (
    SELECT query, seq, export, len(list_intersect(list_distinct(regexp_extract_all(query, '([a-z]+)', 1)), tokens))
      + CASE WHEN contains(query, name) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + depth * 0.1::DOUBLE AS score FROM q, ref))
WHERE rank <= 2 AND score > 0""")
def keyword_category(spark, sf_dir):
    rows = master(spark, sf_dir)
    return L.keyword_categories(rows.select(L.query_string(rows).alias("query")), reference(spark, sf_dir))


@query("resolve_category", f"""WITH {S.CATEGORY}, r AS (SELECT CAST(code AS BIGINT) AS seq, path, 'E' || code AS export FROM cat),
t AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN substr(c.path, instr(c.path, ' > ') + 3) WHEN 1 THEN 'Shop > ' || c.path
  WHEN 2 THEN c.path || ' other' ELSE c.path END AS category
  FROM part JOIN cat c ON c.path = p_type || ' > ' || split_part(p_name, ' ', 2) || ' > ' || split_part(p_name, ' ', 1))
SELECT category, coalesce((SELECT max_by(export, seq) FROM r WHERE path = category),
  (SELECT min_by(export, seq) FROM r WHERE ends_with(path, category) OR ends_with(category, path)), category) AS export FROM t""")
def resolve_category(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(
        F.concat_ws(" > ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("path"), "p_partkey")
    kind = F.col("p_partkey") % 5
    rows = paths.select(F.when(kind == 0, F.regexp_replace("path", "^[^>]* > ", "")).when(kind == 1, F.concat(F.lit("Shop > "), "path")).when(
        kind == 2, F.concat("path", F.lit(" other"))).otherwise(F.col("path")).alias("category"))
    return L.resolve_category(rows, reference(spark, sf_dir))


@query("value_tags", f"WITH {MASTER_SQL} SELECT DISTINCT type AS tag FROM master UNION SELECT DISTINCT family FROM master")
def value_tags(spark, sf_dir):
    return L.value_tags(master(spark, sf_dir))


@query("short_description", f"""WITH {MASTER_SQL}
SELECT sku AS "sku_num_sku_r3", '• ' || upper(substr(type, 1, 1)) || lower(substr(type, 2)) || chr(10) || '• ' || upper(substr(color, 1, 1)) || substr(color, 2)
  || ' · Size ' || size AS short_description FROM master""")
def short_description(spark, sf_dir):
    rows = master(spark, sf_dir)
    return rows.select("sku_num_sku_r3", L.short_description(rows).alias("short_description"))


@query("fill_template", f"""WITH {MASTER_SQL}, {REFERENCE_SQL},
kinds AS (SELECT model_code, CASE WHEN count(DISTINCT color) > 1 AND count(DISTINCT size) > 1 THEN 'color,size' WHEN count(DISTINCT color) > 1 THEN 'color'
  ELSE 'size' END AS variation FROM master GROUP BY 1),
q AS (SELECT sku, lower(concat_ws(' ', family, type, brand_name, color, size, product_name)) AS query FROM master),
best AS (SELECT query, max(CASE WHEN rank = 1 THEN export END) AS one, max(CASE WHEN rank = 2 THEN export END) AS two FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS rank FROM (
    SELECT query, seq, export, len(list_intersect(list_distinct(regexp_extract_all(query, '([a-z]+)', 1)), tokens))
      + CASE WHEN contains(query, name) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + depth * 0.1::DOUBLE AS score FROM (SELECT DISTINCT query FROM q), ref)) GROUP BY 1),
c AS (SELECT raw, min_by(entry, stage * 1000 + seq) AS entry FROM (
  SELECT raw, entry, seq, CASE WHEN name = lower(raw) THEN 1 WHEN contains(name, lower(raw)) THEN 2 ELSE 3 END AS stage
  FROM (SELECT DISTINCT p_brand AS raw FROM part) JOIN {S.values(BRAND_ENTRIES, "seq, entry, name")} ON contains(name, lower(raw)) OR contains(lower(raw), name)) GROUP BY 1)
SELECT product_name AS "Name", sku AS "SellerSKU", model_code AS "ParentSKU", coalesce(c.entry, brand_name) AS "Brand", color,
  one AS "PrimaryCategory", two AS "AdditionalCategory", variation,
  '• ' || upper(substr(type, 1, 1)) || lower(substr(type, 2)) || chr(10) || '• ' || upper(substr(color, 1, 1)) || substr(color, 2) || ' · Size ' || size AS short_description
FROM master JOIN kinds USING (model_code) JOIN q USING (sku) LEFT JOIN best USING (query) LEFT JOIN c ON c.raw = brand_name""")
def fill_template(spark, sf_dir):
    from shelfcheck.sources.rules import small_table

    rows = master(spark, sf_dir)
    brands = small_table(spark, BRAND_ENTRIES, "seq long, brand_entry string, brand_name_lower string")
    return L.fill_template(rows, rows, brands, reference(spark, sf_dir))


@query("product_attributes", f"""WITH {S.prepared()}
SELECT sid AS "PRODUCT_SET_SID", list_sort(list_distinct(list_concat(
    CASE WHEN regexp_matches(name_l, '\\bred\\b') OR lower(COLOR) = 'red' THEN ['red'] ELSE []::VARCHAR[] END,
    CASE WHEN regexp_matches(name_l, '\\bblue\\b') THEN ['blue'] ELSE []::VARCHAR[] END))) AS colors,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name_l, '\\b(red|blue)\\b', '', 'g'),
    '\\b(xxs|xs|small|medium|large|xl|xxl|xxxl)\\b', '', 'g'), '\\b\\d+\\s*(gb|tb)\\b', '', 'g'),
    '\\b(new|original|genuine|authentic|official|premium|quality|best|hot|sale|promo|deal)\\b', '', 'g'), '[^\\w\\s]|\\s+', ' ', 'g')) AS stripped FROM p""".replace(
    "'[^\\w\\s]|\\s+', ' ', 'g')) AS stripped", "'[^\\w]+', ' ', 'g')) AS stripped"))
def product_attributes(spark, sf_dir):
    rows = prepared(spark, sf_dir, columns=["COLOR"], core=["NAME"])
    return rows.select(
        "PRODUCT_SET_SID", L.extract_colors(F.col("NAME"), F.col("COLOR")).alias("colors"),
        L.remove_attributes(F.col("NAME")).alias("stripped"))


@query("match_keys", f"""WITH {S.prepared()}
SELECT sid AS "PRODUCT_SET_SID", {S.squash("trim(lower(BRAND))")} || '|' || {S.squash("trim(lower(NAME))")} || '|' || {S.squash("trim(lower(coalesce(COLOR, '')))")} AS match_key FROM p""")
def match_keys(spark, sf_dir):
    return prepared(spark, sf_dir).select("PRODUCT_SET_SID", T.match_key("BRAND", "NAME", "COLOR").alias("match_key"))


# ---------------------------------------------------------------------------
# Category matching
# ---------------------------------------------------------------------------

from shelfcheck.adapter import categories  # noqa: E402
from shelfcheck.operators import images as I  # noqa: E402
from shelfcheck.operators import matcher as M  # noqa: E402
from shelfcheck.operators import pages as G  # noqa: E402
from shelfcheck.sources.rules import SCHEMAS, RuleSet, small_table  # noqa: E402

STOPS = ["old", "large"]


def _terms_sql(source: str, keys: str, doc: str) -> str:
    return f"""SELECT {keys}, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS term
  FROM (SELECT {keys}, list_filter(string_split({doc}, ' '), lambda w: length(w) >= 2 AND w NOT IN {S.inlist(STOPS)}) AS ws FROM {source})"""


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


INDEX_SQL = f"""docs AS (SELECT CAST(code AS BIGINT) AS seq, path AS category, {_clean_sql('path')} AS doc FROM cat),
dtf AS (SELECT seq, category, term, count(*)::DOUBLE AS tf FROM ({_terms_sql('docs', 'seq, category', 'doc')}) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (count(*) + 1)) + 1 AS idf FROM dtf GROUP BY term
  HAVING count(*) <= 0.95 * (SELECT count(*) FROM docs)),
dw AS (SELECT seq, category, term, tf * idf AS w FROM dtf JOIN idf USING (term)),
posts AS (SELECT seq, category, term, w / sqrt(sum(w * w) OVER (PARTITION BY seq)) AS weight FROM dw)"""


@query("category_index", f"WITH {S.CATEGORY}, {INDEX_SQL} SELECT category, term, round(weight, 8) AS weight FROM posts")
def category_index(spark, sf_dir):
    return M.fit_category_index(categories(spark, sf_dir), STOPS).select("category", "term", F.round("weight", 8).alias("weight"))


@query("category_similarity", f"""WITH {S.prepared()}, {S.CATEGORY}, {INDEX_SQL},
names AS (SELECT DISTINCT {_clean_sql('NAME')} AS text FROM p),
ntf AS (SELECT text, term, count(*)::DOUBLE AS tf FROM ({_terms_sql('names', 'text', 'text')}) GROUP BY ALL),
nw AS (SELECT text, term, tf * idf AS w FROM ntf JOIN idf USING (term)),
nn AS (SELECT text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM nw),
s AS (SELECT text, seq, category, sum(w * weight) AS score FROM nn JOIN posts USING (term) GROUP BY ALL)
SELECT text, category, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(score, 12) DESC, seq) AS rank FROM s WHERE score > 0) WHERE rank <= 20""")
def category_similarity(spark, sf_dir):
    names = prepared(spark, sf_dir, columns=[], core=["NAME"]).select(T.clean_text("NAME").alias("text"))
    index = M.fit_category_index(categories(spark, sf_dir), STOPS)
    return M.category_similarity(names, index, 20, STOPS).select("text", "category", "rank", F.round("score", 6).alias("score"))


CORRECTIONS_SQL = f"""corr AS (SELECT doc_id AS id, {_clean_sql("text")} AS name,
  CASE quality WHEN 1 THEN 'good > text' ELSE 'poor > text' END AS category FROM documents JOIN labels USING (doc_id))"""


def corrections(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("name"),
        F.when(F.col("quality") == 1, "good > text").otherwise("poor > text").alias("category"))


@query("last_corrections", f"""WITH {CORRECTIONS_SQL} SELECT name, max_by(category, id) AS category FROM corr WHERE name <> '' GROUP BY name""")
def last_corrections(spark, sf_dir):
    empty = small_table(spark, [], SCHEMAS["correction"])
    return M.last_corrections(M.append_corrections(empty, corrections(spark, sf_dir)))


@query("classified_names")
def classified_names(spark, sf_dir):
    rows = corrections(spark, sf_dir)
    model = M.train_classifier(rows, iterations=20)
    return M.classify(rows.select(T.clean_text("name").alias("text")), model)


def category_rules(spark, sf_dir) -> RuleSet:
    """Category table plus keyword weights, corrections and suppression tables for the prediction."""
    rules = R.rule_set(spark, sf_dir)
    weights = [("economy > gear > red", "red gear", 0.4), ("gear", "gear", 0.2), ("large > bolt > hot", "hot", 0.3), ("old", "bolt old", 0.5)]
    fixed = [(1, "red ring economy", "SMALL > bolt > hot"), (2, "red ring economy", "LARGE > rod > cold")]
    return RuleSet(spark, {
        "category": categories(spark, sf_dir), "keyword_weight": small_table(spark, weights, SCHEMAS["keyword_weight"]),
        "correction": small_table(spark, fixed, SCHEMAS["correction"]),
        "same_domain": small_table(spark, [("small", "promo > bolt > hot")], SCHEMAS["same_domain"]),
        "cross_block": small_table(spark, [(1, "anvil", "medium"), (1, "anvil", "large")], SCHEMAS["cross_block"]),
        "flags": rules.get("flags"),
    }, R.MARKET)


# Listings in a category other than their own: the type level is rotated for every third model.
ROTATED = "replace(replace(replace(CATEGORY, 'ECONOMY', 'LARGE'), 'MEDIUM', 'SMALL'), 'bolt', 'rod')"

# Of these, some without a category and some under Miscellaneous; and codes, of which a third are blank.
GIVEN = f"CASE WHEN coalesce(try_cast({{code}} AS BIGINT), 0) % 7 = 0 THEN '' WHEN coalesce(try_cast({{code}} AS BIGINT), 0) % 11 = 0 THEN 'Miscellaneous' ELSE {ROTATED} END"
GIVEN_CODE = "CASE WHEN coalesce(try_cast({code} AS BIGINT), 0) % 3 = 1 THEN '' ELSE {code} END"


# Names with their clean text, the twenty nearest categories with the keyword boost of each, and the staged choice.
PREDICTED_SQL = f"""{INDEX_SQL},
texts AS (SELECT DISTINCT NAME, {_clean_sql('NAME')} AS text, lower(NAME) AS low FROM p),
names AS (SELECT DISTINCT text FROM texts),
ntf AS (SELECT text, term, count(*)::DOUBLE AS tf FROM ({_terms_sql('names', 'text', 'text')}) GROUP BY ALL),
nw AS (SELECT text, term, tf * idf AS w FROM ntf JOIN idf USING (term)),
nn AS (SELECT text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM nw),
sim AS (SELECT text, seq, category, sum(w * weight) AS score FROM nn JOIN posts USING (term) GROUP BY ALL HAVING sum(w * weight) > 0),
near AS (SELECT NAME, low, seq, category, lower(category) AS cl, score FROM texts JOIN (SELECT * FROM sim
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(score, 12) DESC, seq) <= 20) USING (text)),
boosted AS (SELECT NAME, seq, category, score, score + 0.6 * CASE
  WHEN cl = 'economy > gear > red' THEN CASE WHEN regexp_matches(low, '\\bred gear\\b') THEN 0.4 ELSE 0 END
  WHEN cl = 'large > bolt > hot' THEN CASE WHEN regexp_matches(low, '\\bhot\\b') THEN 0.3 ELSE 0 END
  WHEN cl LIKE '%> gear' THEN CASE WHEN regexp_matches(low, '\\bgear\\b') THEN 0.2 ELSE 0 END
  WHEN cl LIKE '%> old' THEN CASE WHEN regexp_matches(low, '\\bbolt old\\b') THEN 0.5 ELSE 0 END
  ELSE 0 END AS final FROM near),
best AS (SELECT NAME, max(final) AS top_final, max(score) AS top_score FROM boosted GROUP BY NAME),
first_final AS (SELECT NAME, category FROM boosted
  QUALIFY row_number() OVER (PARTITION BY NAME ORDER BY round(final, 12) DESC, round(score, 12) DESC, seq) = 1),
first_plain AS (SELECT NAME, category FROM boosted QUALIFY row_number() OVER (PARTITION BY NAME ORDER BY round(score, 12) DESC, seq) = 1),
leaves AS (SELECT lower(trim(string_split(path, '>')[-1])) AS leaf, min(CAST(code AS BIGINT)) AS seen, max_by(path, CAST(code AS BIGINT)) AS category
  FROM cat GROUP BY 1),
leafy AS (SELECT NAME, min_by(category, seen) AS category FROM texts JOIN leaves ON regexp_matches(low, '\\b' || leaf || '\\b') GROUP BY NAME),
predicted AS (SELECT t.NAME, CASE WHEN t.text = 'red ring economy' THEN 'LARGE > rod > cold' WHEN top_final >= 0.35 THEN f.category
  WHEN top_score > 0.35 THEN s.category ELSE l.category END AS predicted
  FROM texts t LEFT JOIN best USING (NAME) LEFT JOIN first_final f USING (NAME) LEFT JOIN first_plain s USING (NAME) LEFT JOIN leafy l USING (NAME))"""


def _levels_sql(c: str) -> str:
    return f"list_transform(string_split({c}, '>'), lambda x: lower(trim(x)))"


def _long_words_sql(c: str) -> str:
    return f"list_filter(string_split({_clean_sql(c)}, ' '), lambda w: length(w) >= 4 AND w NOT IN ('with', 'from'))"


WRONG_SQL = f"""WITH {S.prepared()}, {S.CATEGORY}, {PREDICTED_SQL},
paths AS (SELECT lower(path) AS lp, max_by(path, CAST(code AS BIGINT)) AS path FROM cat GROUP BY 1),
given AS (SELECT sid, p.NAME, predicted, trim({GIVEN.format(code="cat")}) AS given, {GIVEN_CODE.format(code="cat")} AS code
  FROM p LEFT JOIN predicted ON predicted.NAME = p.NAME),
listed AS (SELECT sid, NAME, predicted, cat.path AS code_path, CASE WHEN lower(given) IN ('', 'nan', 'none', 'miscellaneous')
  THEN coalesce(cat.path, given) ELSE given END AS cur FROM given LEFT JOIN cat USING (code)),
both_paths AS (SELECT l.*, lower(cur) AS cl, coalesce(code_path, paths.path, cur) AS full_path FROM listed l LEFT JOIN paths ON lp = lower(cur)),
levels AS (SELECT *, {_levels_sql('predicted')} AS pl, {_levels_sql('cur')} AS lv, {_levels_sql('full_path')} AS fl FROM both_paths
  WHERE cl NOT IN ('', 'nan', 'none'))
SELECT sid, 'Wrong Category' AS flag, CASE WHEN contains(cl, 'miscellaneous') THEN 'Category is ''Miscellaneous'''
  ELSE 'Wrong Category. Suggested: ' || predicted END AS detail FROM levels
WHERE contains(cl, 'miscellaneous') OR (predicted <> '' AND lower(predicted) <> cl AND NOT contains(lower(predicted), lv[-1])
  AND len(list_filter([1, 2, 3], lambda i: pl[i] = fl[i])) < least(2, len(pl), len(fl))
  AND NOT (pl[1] = 'small' AND cl = 'promo > bolt > hot')
  AND NOT ((contains(cl, 'anvil') OR contains(lower(full_path), 'anvil')) AND (starts_with(pl[1], 'medium') OR starts_with(pl[1], 'large')))
  AND NOT (starts_with(fl[1], 'books') OR starts_with(fl[1], 'movies') OR starts_with(fl[1], 'music'))
  AND len(list_filter({_long_words_sql("array_to_string(fl[-2:], ' ')")}, lambda t:
    len(list_filter({_long_words_sql('NAME')}, lambda n: contains(n, t) OR contains(t, n))) > 0)) = 0
  AND pl[-1] <> lv[-1])"""


@query("wrong_category", WRONG_SQL)
def wrong_category(spark, sf_dir):
    rows = prepared(spark, sf_dir, columns=["CATEGORY"], core=["NAME", "CATEGORY_CODE"]).select(M.SID, "NAME", "CATEGORY", "CATEGORY_CODE").withColumns({
        "CATEGORY": F.expr(GIVEN.format(code="substring_index(CATEGORY_CODE, '.', 1)")),
        "CATEGORY_CODE": F.expr(GIVEN_CODE.format(code="substring_index(CATEGORY_CODE, '.', 1)"))})
    return M.wrong_category(materialize(rows, "given"), category_rules(spark, sf_dir), stop_words=STOPS).select("sid", "flag", "detail")


@query("predicted_categories", f"WITH {S.prepared()}, {S.CATEGORY}, {PREDICTED_SQL} SELECT NAME, predicted FROM predicted")
def predicted_categories(spark, sf_dir):
    return M.predict_categories(prepared(spark, sf_dir, columns=[], core=["NAME"]).select("NAME"), category_rules(spark, sf_dir), stop_words=STOPS)


# ---------------------------------------------------------------------------
# Pages
# ---------------------------------------------------------------------------


def _plain_sql(c: str, glue: str = " ") -> str:
    out = f"regexp_replace({c}, '(?s)<[^>]*>', '{glue}', 'g')"
    for entity, char in G.ENTITIES:
        out = f"replace({out}, '{entity}', '{S.lit(char)[1:-1]}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("page_titles", f"""SELECT page_id, coalesce(nullif({_plain_sql("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}, ''),
  nullif({_plain_sql("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}, ''), '') AS heading FROM pages""")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.heading_text(F.col("html")).alias("heading"))


@query("page_links", f"""SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1),
  lambda a: {_plain_sql('a', '')}), lambda t: t <> '') AS links FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.link_texts(F.col("html")).alias("links"))


@query("page_category_path", f"""WITH lists AS (
SELECT page_id, list_transform(list_concat(regexp_extract_all(html, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1),
  regexp_extract_all(html, '(?is)<ol\\b[^>]*>(.*?)</ol>', 1), regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1)),
  lambda b: list_filter(list_transform(regexp_extract_all(b, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda a: {_plain_sql('a', '')}), lambda t: t <> '')) AS ls
FROM pages), one AS (SELECT page_id, list_filter(ls, lambda l: len(l) BETWEEN 3 AND 7 AND len(list_distinct(l)) = len(l)
  AND len(list_filter(l, lambda x: length(x) >= 50)) = 0)[1] AS l FROM lists)
SELECT page_id, nullif(array_to_string(CASE WHEN lower(l[1]) = 'home' THEN l[2:] ELSE l END, ' > '), '') AS path FROM one""")
def page_category_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.page_category_path(F.col("html")).alias("path"))


@query("listing_page_count", """SELECT page_id, coalesce(list_max(list_transform(list_concat(
  regexp_extract_all(html, '(?i)\\bdata-page=["''](\\d+)', 1), regexp_extract_all(html, '(?is)<a\\b[^>]*href=["''][^"'']*?page=(\\d+)', 1)),
  lambda n: CAST(n AS BIGINT))), 1) AS pages FROM pages""")
def listing_page_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.listing_page_count(F.col("html")).alias("pages"))


# The stored pages are prose: breadcrumb-like lists and headings, but no product markup. The SQL looks for the markup and
# the phrases that a field could come from; a page that had one would read 'marked' in every field and so not match.
PRODUCT_MARKUP = (r"(?i)ld\+json|dataLayer|__STORES__|og:image|data-rating|#reviews|jmall|<form|<button|<h[234]|"
                  r"class=[\"'][^\"']*(prc|-b -ltr|dsct|discount|stock|avail|stars|revw|spec|-pvs|seller|store|desc|-fs14|-fw|var|size|color)")
PRODUCT_PHRASES = (r"(?i)no\s+ratings?|verified\s+rating|in\s+stock|out\s+of\s+stock|sold\s+out|low\s+stock|only\s+\d+\s+left|hurry|warranty|"
                   r"guarantee|seller\s+info|official\s+store|\bmodel\s*[:-]|gtin|weight\s*[(:-]")
COLOR_WORDS = (r"(?i)\b(black|white|silver|gold|blue|red|green|purple|pink|grey|gray|titanium|midnight|starlight|ivory|champagne|rose|copper|"
               r"yellow|orange|violet|navy|cream|brown|coral|aqua|cyan|teal|lilac|maroon|beige|olive|turquoise)\b")
EMPTY_FIELDS = ["PRICE", "DISCOUNT", "MODEL", "GTIN", "BRAND", "MAIN_IMAGE", "WEIGHT", "COLOR", "COUNT_VARIATIONS", "SIZES_AVAILABLE",
                "PRODUCT_WARRANTY", "WARRANTY_DURATION", "RATING", "REVIEW_COUNT", "SELLER_NAME", "DESCRIPTION", "KEY_FEATURES", "KEY_SPECS",
                "SPECIFICATIONS", "WHATS_IN_BOX"]


@query("page_fields", f"""WITH h AS ({ORACLES['page_titles']}), c AS ({ORACLES['page_category_path']}),
m AS (SELECT page_id, url, path, regexp_matches(html, {S.lit(PRODUCT_MARKUP)}) OR regexp_matches(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), {S.lit(PRODUCT_PHRASES)})
  OR regexp_matches(heading, {S.lit(COLOR_WORDS)}) AS marked FROM pages JOIN h USING (page_id) JOIN c USING (page_id))
SELECT page_id, url, path AS "CATEGORY_PATH", CASE WHEN marked THEN 'marked' ELSE 'In Stock' END AS "STOCK_STATUS",
  CASE WHEN marked THEN 'marked' ELSE 'No' END AS "IS_OFFICIAL_STORE", CASE WHEN marked THEN 'marked' ELSE 'None' END AS "COLOR_IN_TITLE",
  {", ".join(f"CASE WHEN marked THEN 'marked' END AS \"{f}\"" for f in EMPTY_FIELDS)} FROM m""")
def page_fields(spark, sf_dir):
    return G.extract_pages(table(spark, sf_dir, "pages"))


PAGE_TEMPLATE = """<html><head><title>%name% deal</title><meta property="og:image" content="http://img.example.org/%key%.png"/>
<script type="application/ld+json">[{"@type":"Offer"},{"@type":"Product","brand":{"name":"%brand%"},"gtin13":"%gtin%",
"offers":{"price":"%price%","availability":"http://schema.org/InStock"},"aggregateRating":{"ratingValue":"4.%size%","reviewCount":"%size%"}}]</script>
</head><body><nav><a href="/help">Help</a></nav><ol class="breadcrumb"><a href="/">Home</a><a href="/t">%type%</a><a href="/n">%noun%</a></ol>
<h1>%name%</h1><span class="prc">KSh %key%,500</span><span class="bdg _dsct _sm">%size%%</span>
<ul class="-pvs -mvs"><li><span>S</span><span>x</span></li><li><span>EU %size%</span></li><li><span>Red</span></li><li><span>Colour Red</span></li></ul>
<div class="seller-info"><a href="/s">Vendor %size%</a></div><p>Comes with %size% months warranty.</p>
<div class="specs"><ul><li>Model: M%key%</li><li>Weight (kg): %size%</li><li>Main Material: Steel</li></ul></div>
<h3>Key Features</h3><ul><li>Strong %noun%</li><li>Light</li></ul><h3>What's in the Box</h3><ul><li>1 x %noun%</li></ul>
<h2>Product details</h2><p>The %name% is here.</p><p>The %name% is here.</p><h2>Specifications</h2><p>none</p></body></html>"""


def product_pages(spark, sf_dir, template: str = PAGE_TEMPLATE) -> DataFrame:
    # spread before the pages are made, so that no shuffle has them
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice", "p_size", "p_type"))
    cells = {
        "%name%": F.col("p_name"), "%key%": (F.col("p_partkey") % 900 + 1).cast("string"), "%brand%": F.col("p_brand"),
        "%gtin%": F.lpad(F.col("p_partkey").cast("string"), 13, "7"), "%price%": F.format_number("p_retailprice", 2),
        "%size%": F.col("p_size").cast("string"), "%type%": F.col("p_type"), "%noun%": F.split_part("p_name", F.lit(" "), F.lit(2)),
    }
    html = F.lit(template)
    for mark, value in cells.items():
        html = F.replace(html, F.lit(mark), value)
    return part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query("page_product_fields", """
SELECT p_partkey AS page_id, 'KSh ' || format('{:,.0f}', (p_partkey % 900 + 1) * 1000 + 500.0) AS "PRICE", p_size || '%' AS "DISCOUNT", 'In stock' AS "STOCK_STATUS",
  'M' || (p_partkey % 900 + 1) AS "MODEL", lpad(CAST(p_partkey AS VARCHAR), 13, '7') AS "GTIN", p_brand AS "BRAND",
  p_type || ' > ' || split_part(p_name, ' ', 2) AS "CATEGORY_PATH", 'No' AS "IS_OFFICIAL_STORE",
  'http://img.example.org/' || (p_partkey % 900 + 1) || '.png' AS "MAIN_IMAGE", CAST(p_size AS VARCHAR) AS "WEIGHT", 'Red' AS "COLOR",
  CASE WHEN p_name LIKE 'red %' THEN 'Red' WHEN p_name LIKE 'blue %' THEN 'Blue' ELSE 'None' END AS "COLOR_IN_TITLE", '2' AS "COUNT_VARIATIONS",
  'S, EU ' || p_size AS "SIZES_AVAILABLE", 'Yes' AS "PRODUCT_WARRANTY", p_size || ' months warranty' AS "WARRANTY_DURATION", '4.' || p_size AS "RATING",
  CAST(p_size AS VARCHAR) AS "REVIEW_COUNT", 'Vendor ' || p_size AS "SELLER_NAME", '<p>The ' || p_name || ' is here.</p>' AS "DESCRIPTION",
  'Strong ' || split_part(p_name, ' ', 2) || ' | Light' AS "KEY_FEATURES",
  'SKU: M' || (p_partkey % 900 + 1) || ' | Weight: ' || p_size || ' | Material: Steel' AS "KEY_SPECS",
  'Model: M' || (p_partkey % 900 + 1) || ' | Weight (kg): ' || p_size || ' | Main Material: Steel | SKU: M' || (p_partkey % 900 + 1) AS "SPECIFICATIONS",
  '1 x ' || split_part(p_name, ' ', 2) AS "WHATS_IN_BOX" FROM part""".replace("'2' AS \"COUNT", "'2' AS \"COUNT").replace("'In stock'", "'In Stock'"))
def page_product_fields(spark, sf_dir):
    return G.extract_pages(product_pages(spark, sf_dir))


NESTED_BLOCKS = """<html><body><div class="row"><div class="-prd-desc x"><div>The %name% <div>in size %size%</div></div><p>of %brand%</p></div>
<p>outside</p></div><div class="card specs"><div><ul><li>Model: M%key%</li></ul></div><ul><li>Finish: %noun%</li></ul></div><ul><li>Not: part</li></ul></body></html>"""
NESTED_DETAILS = """<html><body><h2>Product details</h2><div>The %name% in a longer block <div>of size %size%</div> ends here</div><div>small<p>kept %key%</p></div>
<div class="promo-box"><p class="note">%brand%</p></div><ul><li>a<ul><li>%noun%</li></ul></li><li>c</li></ul><h3>Delivery terms</h3><p>none</p></body></html>"""


@query("page_nested_blocks", """WITH n AS (SELECT *, split_part(p_name, ' ', 2) AS noun, CAST(p_partkey % 900 + 1 AS VARCHAR) AS key FROM part)
SELECT p_partkey AS page_id, 'blocks' AS form, '<div class="-prd-desc x"><div>The ' || p_name || ' <div>in size ' || p_size || '</div></div><p>of ' || p_brand || '</p></div>' AS description,
  'Model: M' || key || ' | Finish: ' || noun || ' | SKU: M' || key AS specifications FROM n
UNION ALL
SELECT p_partkey, 'details', '<div>The ' || p_name || ' in a longer block <div>of size ' || p_size || '</div> ends here</div>' || chr(10) || '<p>kept ' || key || '</p>' || chr(10)
  || '<p class="note">' || p_brand || '</p>' || chr(10) || '<ul><li>a<ul><li>' || noun || '</li></ul></li><li>c</li></ul>', NULL FROM n""")
def page_nested_blocks(spark, sf_dir):
    forms = [G.extract_pages(product_pages(spark, sf_dir, html)).select("page_id", F.lit(form).alias("form"), F.col("DESCRIPTION").alias("description"),
                                                                       F.col("SPECIFICATIONS").alias("specifications"))
             for form, html in (("blocks", NESTED_BLOCKS), ("details", NESTED_DETAILS))]
    return forms[0].unionByName(forms[1])


CARD = """<article class="prd _fb" data-id="%key%" data-seller="s%size%"><a class="core" href="/p-%key%.html"><img data-src="/i/%key%.png" src="x"/>
<h3 class="name">%name% A</h3><div class="brand">%brand%</div><div class="prc">KSh %price%</div><div class="old">KSh 9,%size%</div><div class="bdg _dsct">10%</div>
<div class="stars _s" style="width:%stars%%"></div><div class="rev">(%size%)</div></a></article>
<article class="prd"><a class="core" href="/x-1%gtin%.html"><div class="name">%name% B</div><svg class="xpr"></svg></a></article>"""


@query("listing_cards", """
SELECT p_partkey AS page_id, 0 AS pos, CAST(p_partkey AS VARCHAR) AS "SKU", p_name || ' A' AS "Name", p_brand AS "Brand",
  replace(format('{:.2f}', p_retailprice), ',', '') AS "Price", '9' || p_size AS "Old Price", '10%' AS "Discount",
  CAST(round_even((p_size % 11) * 10 / 20.0::DOUBLE, 1) AS VARCHAR) AS "Rating", CAST(p_size AS VARCHAR) AS "Total Ratings", 's' || p_size AS "Seller",
  'No' AS "Express", 'No' AS "Shop Global", 'http://shop.example.org/i/' || p_partkey || '.png' AS "Image URL",
  'http://shop.example.org/p-' || p_partkey || '.html' AS "Product URL", 'In Stock' AS "Stock", '' AS "Tags" FROM part
UNION ALL SELECT p_partkey, 1, '1' || lpad(CAST(p_partkey AS VARCHAR), 8, '7'), p_name || ' B', '', '', '', '', '', '', '', 'Yes', 'No', '',
  'http://shop.example.org/x-1' || lpad(CAST(p_partkey AS VARCHAR), 8, '7') || '.html', 'In Stock', '' FROM part""")
def listing_cards(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    html = F.lit(CARD)
    for mark, value in {
        "%name%": F.col("p_name"), "%key%": F.col("p_partkey").cast("string"), "%brand%": F.col("p_brand"),
        "%gtin%": F.lpad(F.col("p_partkey").cast("string"), 8, "7"), "%price%": F.format_number("p_retailprice", 2),
        "%size%": F.col("p_size").cast("string"), "%stars%": ((F.col("p_size") % 11) * 10).cast("string"),
    }.items():
        html = F.replace(html, F.lit(mark), value)
    return G.listing_cards(part.select(F.col("p_partkey").alias("page_id"), html.alias("html")), "http://shop.example.org")


@query("enriched_listings", f"""WITH {S.prepared()},
pg AS (SELECT 'M' || p_partkey AS m, p_size || ' months warranty' AS w FROM part)
SELECT sid AS "PRODUCT_SET_SID", coalesce(p.WARRANTY_DURATION, pg.w) AS "WARRANTY_DURATION", p.COLOR AS "COLOR" FROM p LEFT JOIN pg ON m = PARENTSKU""")
def enriched_listings(spark, sf_dir):
    kept = ["PARENTSKU", "COLOR", "WARRANTY_DURATION"]
    rows = prepared(spark, sf_dir, columns=kept, core=[]).select("PRODUCT_SET_SID", *kept)
    pages = G.extract_pages(product_pages(spark, sf_dir)).withColumn("PARENTSKU", F.concat(F.lit("M"), F.col("page_id").cast("string")))
    filled = P.fill_from_pages(rows, pages.select("PARENTSKU", "WARRANTY_DURATION", "COLOR"), ["WARRANTY_DURATION", "COLOR"], "PARENTSKU")
    return filled.select("PRODUCT_SET_SID", "WARRANTY_DURATION", "COLOR")


# ---------------------------------------------------------------------------
# Images
# ---------------------------------------------------------------------------


@query("visual_duplicates", """WITH e AS (
  SELECT vec_id, vec_id AS origin, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  UNION ALL SELECT vec_id + 10000000, CASE WHEN vec_id % 5 = 0 THEN vec_id ELSE vec_id + 10000000 END, label,
    list_concat(CAST(embedding AS DOUBLE[])[1:52], list_resize([]::DOUBLE[], len(embedding) - 52, 0.0)) FROM embeddings),
s AS (SELECT CAST(vec_id AS VARCHAR) AS sid, origin, label,
  CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN v[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END)) AS UBIGINT) AS sig FROM e),
p AS (SELECT a.sid, b.sid AS other, bit_count(xor(a.sig, b.sig)) AS d FROM s a JOIN s b ON a.label = b.label AND a.origin <> b.origin
  WHERE bit_count(xor(a.sig, b.sig)) <= 12)
SELECT sid, min(other) AS other, round(1 - min_by(d, other) / 64.0, 6) AS similarity FROM p GROUP BY sid""")
def visual_duplicates(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").withColumn("origin", F.col("vec_id"))
    cropped = own.withColumns({
        "vec_id": F.col("vec_id") + 10000000, "origin": F.when(F.col("vec_id") % 5 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 10000000),
        "embedding": F.transform("embedding", lambda x, i: F.when(i < 52, x).otherwise(0.0).cast("float"))})
    rows = own.unionByName(cropped).select(
        F.col("vec_id").cast("string").alias("PRODUCT_SET_SID"), F.col("label").alias("_seller_lower"), "origin",
        I.sign_signature("embedding").alias("signature"))
    return I.first_partners(rows).select("sid", "other", F.round("similarity", 6).alias("similarity"))


from shelfcheck_queries import sources  # noqa: E402, F401
