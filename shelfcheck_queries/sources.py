"""Registered queries over readers, writers, rule loaders and text functions: files and sheets made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.adapter import catalog, table
from shelfcheck.functions import prices
from shelfcheck.functions import text as T
from shelfcheck.operators import postqc as P
from shelfcheck.session import work_dir
from shelfcheck.sources import files, rules, sinks
from shelfcheck_queries import sql as S
from shelfcheck_queries.queries import query


def folder(spark, kind: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, sep: str, encoding: str = "UTF-8") -> str:
    """The table as CSV files; fields keep their white space, quotes and line breaks."""
    path = folder(df.sparkSession, "csv")
    (df.write.option("header", True).option("sep", sep).option("encoding", encoding).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


# ---------------------------------------------------------------------------
# Readers and writers
# ---------------------------------------------------------------------------


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


def _digests(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("chars"), "source")


TEXTS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS chars, source FROM documents"


@query("read_catalog_csv", TEXTS)
def read_catalog_csv(spark, sf_dir):
    return _digests(files.read_catalog_csv(spark, written(_texts(spark, sf_dir), ";")))


@query("read_pipe_csv", TEXTS)
def read_pipe_csv(spark, sf_dir):
    return _digests(files.read_pipe_csv(spark, written(_texts(spark, sf_dir), "|")))


PARTS = """SELECT CAST(p_partkey AS VARCHAR) AS id, 'Pièce "' || p_name || '",' || chr(10) || 'taille; ' || p_size AS name, p_brand AS brand FROM part"""


def _parts(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit('Pièce "'), "p_name", F.lit('",\ntaille; '), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("brand"))


@query("read_catalog_single_byte", PARTS)
def read_catalog_single_byte(spark, sf_dir):
    return files.read_catalog_csv(spark, written(_parts(spark, sf_dir), "\t", "ISO-8859-1")).drop("_seq")


@query("read_csv_semicolon_fallback", PARTS)
def read_csv_semicolon_fallback(spark, sf_dir):
    return files.read_csv_semicolon_fallback(spark, written(_parts(spark, sf_dir), ";", "ISO-8859-1")).drop("_seq")


@query("read_master", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, md5(coalesce(html, '')) AS html_md5 FROM pages")
def read_master(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = files.read_master(spark, written(pages, ","))
    return rows.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("html_md5"))


@query("read_many", """SELECT 'P' || p_partkey AS "PRODUCT_SET_SID", p_name || ' don’t' AS "NAME", p_brand AS "BRAND", CAST(NULL AS VARCHAR) AS "SELLER_NAME",
  0 AS file FROM part
UNION ALL SELECT 'S' || s_suppkey, 'Café ' || s_name, CAST(NULL AS VARCHAR), s_name, 1 FROM supplier""")
def read_many(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("cod_productset_sid"),
        F.concat("p_name", F.lit(" donâ€™t")).alias("dsc_name"), F.col("p_brand").alias("BRAND"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(" S"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("PRODUCT_SET_SID"),
        F.concat(F.lit("Café "), "s_name").alias("NAME"), F.col("s_name").alias("SELLER_NAME"))
    rows = files.read_many(spark, [written(part, ";"), written(supplier, ",", "ISO-8859-1")])
    return rows.select("PRODUCT_SET_SID", "NAME", "BRAND", "SELLER_NAME", F.col("_file").alias("file"))


@query("write_csv_bom", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def write_csv_bom(spark, sf_dir):
    path = folder(spark, "bom")
    sinks.write_csv_bom(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    return files.read_catalog_csv(spark, path).drop("_seq")


@query("write_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def write_parquet(spark, sf_dir):
    path = folder(spark, "parquet")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    sinks.write_parquet(rows, path, ["source"])
    return spark.read.parquet(path).select("doc_id", "lang", F.col("source").cast("string").alias("source"), "n_chars")


@query("read_word_list", "SELECT DISTINCT 'names' AS list_name, lower(trim(s_name)) AS word FROM supplier")
def read_word_list(spark, sf_dir):
    path = folder(spark, "words")
    table(spark, sf_dir, "supplier").select(F.concat(F.lit("  "), "s_name", F.lit(" "))).write.text(path)
    return files.read_word_list(spark, path, "names", lower=True)


# ---------------------------------------------------------------------------
# Rule loaders
# ---------------------------------------------------------------------------


def _sheet(spark, sf_dir, name: str, seq: str, **columns) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(seq).cast("long").alias("rule_seq"), *[F.expr(e).alias(c.replace("_", " ")) for c, e in columns.items()])


@query("load_prohibited", """SELECT lower(p_name) || ' ' || p_partkey AS keyword,
  CASE WHEN p_size % 3 = 0 THEN []::VARCHAR[] ELSE [CAST(p_size AS VARCHAR), CAST(p_size + 100 AS VARCHAR)] END AS categories FROM part""")
def load_prohibited(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, "part", "p_partkey", Keywords="concat(initcap(p_name), ' ', p_partkey, ' ')",
                   Category="CASE WHEN p_size % 3 <> 0 THEN concat(p_size, '.0, ', p_size + 100) END")
    return rules.load_prohibited(sheet, "KE").select("keyword", "categories")


@query("load_restricted_brands", """SELECT lower(p_brand) AS brand, any_value(p_brand) AS brand_raw,
  list_sort(list(DISTINCT 'seller ' || p_size)) AS sellers, list_sort(list(DISTINCT p_size || '7')) AS categories FROM part GROUP BY 1""")
def load_restricted_brands(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, "part", "p_partkey", brand="concat(p_brand, ' ')", approved_sellers="concat('Seller ', p_size)",
                   categories="concat(p_size, '7.0')", variations="CAST(NULL AS STRING)")
    rows = rules.load_restricted_brands(sheet, "KE")
    return rows.select("brand", "brand_raw", F.array_sort("sellers").alias("sellers"), F.array_sort("categories").alias("categories"))


@query("load_seller_list", "SELECT DISTINCT 'perfume' AS program, lower(s_name) AS seller FROM supplier")
def load_seller_list(spark, sf_dir):
    sheet = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS id", "concat(' ', upper(s_name)) AS SellerName")
    return rules.load_seller_list(sheet, "KE", "perfume").select("program", "seller").distinct()


@query("load_refurb_sellers", """SELECT DISTINCT 'refurb_phones' AS program, lower(s_name) AS seller FROM supplier WHERE s_suppkey % 2 = 0
UNION SELECT 'refurb_laptops', lower(s_name) FROM supplier WHERE s_suppkey % 3 = 0""")
def load_refurb_sellers(spark, sf_dir):
    sheet = table(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS Phones", "CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, ' ') END AS Laptops")
    return rules.load_refurb_sellers(sheet, "KE").select("program", "seller").distinct()


@query("load_price_caps", """SELECT 'KE' AS country, CAST(p_partkey AS VARCHAR) AS code, CAST(p_size * 100 AS DOUBLE) AS cap_local FROM part
UNION ALL SELECT 'UG', CAST(p_partkey AS VARCHAR), CAST(p_size * 10 AS DOUBLE) FROM part WHERE p_partkey % 2 = 0""")
def load_price_caps(spark, sf_dir):
    sheet = table(spark, sf_dir, "part").selectExpr(
        "p_name AS name", "concat('00', p_partkey) AS category_code", "CAST(p_size * 100 AS STRING) AS KE",
        "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 10 AS STRING) ELSE 'x' END AS UG")
    return rules.load_price_caps(sheet, ["KE", "UG"]).select("country", "code", "cap_local")


@query("load_ng_books", "SELECT lower(p_name) || ' ' || p_partkey AS title, CASE WHEN p_size % 2 = 0 THEN 'seller ' || p_size END AS seller FROM part")
def load_ng_books(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, "part", "p_partkey", Book="concat(initcap(p_name), ' ', p_partkey)",
                   Seller="CASE WHEN p_size % 2 = 0 THEN concat(' Seller ', p_size) END")
    return rules.load_ng_books(sheet).select("title", "seller")


@query("load_reference_categories", """SELECT 'E' || p_partkey AS export_category, lower(p_name) AS category_name_lower,
  len(list_distinct(string_split(lower(p_type || ' ' || p_name), ' '))) AS tokens FROM part""")
def load_reference_categories(spark, sf_dir):
    sheet = table(spark, sf_dir, "part").selectExpr(
        "concat(' E', p_partkey, ' ') AS export_category", "p_name AS category_name", "concat(p_type, ' / ', p_name) AS `Category Path`")
    rows = rules.load_reference_categories(sheet)
    return rows.select("export_category", "category_name_lower", F.size("path_tokens").cast("long").alias("tokens"))


@query("load_reference_brands", "SELECT DISTINCT lower(p_brand) || ' - ' || p_size AS brand_name_lower FROM part")
def load_reference_brands(spark, sf_dir):
    sheet = table(spark, sf_dir, "part").selectExpr("concat(p_partkey, ' - ', p_brand, ' - ', p_size) AS b")
    return rules.load_reference_brands(sheet).select("brand_name_lower").distinct()


# ---------------------------------------------------------------------------
# Text functions and the listing path
# ---------------------------------------------------------------------------


@query("repair_mojibake", r"""SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS text_md5 FROM documents""")
def repair_mojibake(spark, sf_dir):
    wrong = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").select("doc_id", wrong.alias("wrong"))
    return rows.select("doc_id", F.md5(T.repair_mojibake("wrong").cast("binary")).alias("text_md5"))


@query("parse_price", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(round(p_retailprice, 2) AS VARCHAR) END AS price FROM part""")
def parse_price(spark, sf_dir):
    shown = F.when(F.col("p_size") % 7 == 0, "on request").otherwise(F.concat(F.lit("KSh "), F.format_number("p_retailprice", 2)))
    return table(spark, sf_dir, "part").select("p_partkey", prices.parse_price(shown).alias("price"))


@query("key_functions", rf"""WITH {S.raw()}
SELECT sid AS "PRODUCT_SET_SID", split_part(sid, '-', 1) AS base_sku, regexp_replace(lower(NAME), '[^a-z0-9]', '', 'g') AS alnum_key,
  lower(replace(CATEGORY, ' > ', ' / ')) AS path FROM raw""")
def key_functions(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        "PRODUCT_SET_SID", T.base_sku("PRODUCT_SET_SID").alias("base_sku"), T.alnum_key("NAME").alias("alnum_key"),
        T.normalize_path_separator("CATEGORY").alias("path"))


@query("color_from_title", f"""WITH {S.raw()} SELECT sid AS "PRODUCT_SET_SID", coalesce(COLOR, 'None') AS "COLOR" FROM raw""")
def color_from_title(spark, sf_dir):
    rows = catalog(spark, sf_dir).select("PRODUCT_SET_SID", F.col("COLOR").alias("COLOR_IN_TITLE"))
    return P.color_from_title(rows).select("PRODUCT_SET_SID", "COLOR")


@query("lookup_inputs", f"""WITH {S.raw()}
SELECT arg_min(line, _seq) AS input, sku, arg_min(CASE WHEN link THEN line ELSE '' END, _seq) AS url,
  arg_min(CASE WHEN link THEN CASE WHEN partkey % 4 = 0 THEN 'KE' ELSE 'NG' END ELSE '' END, _seq) AS country FROM (
  SELECT _seq, partkey, partkey % 2 = 0 AS link,
    CASE WHEN partkey % 2 = 0 THEN 'https://www.shop.' || CASE WHEN partkey % 4 = 0 THEN 'co.ke' ELSE 'com.ng' END || '/item-' || (1000000 + partkey) || '.html' ELSE sid END AS line,
    CASE WHEN partkey % 2 = 0 THEN CAST(1000000 + partkey AS VARCHAR) ELSE split_part(sid, '-', 1) END AS sku FROM raw)
GROUP BY sku""")
def lookup_inputs(spark, sf_dir):
    key = F.split_part(F.substring("PRODUCT_SET_SID", 2, 40), F.lit("-"), F.lit(1)).cast("long")
    link = F.concat(F.lit("https://www.shop."), F.when(key % 4 == 0, "co.ke").otherwise("com.ng"), F.lit("/item-"),
                    (key + 1000000).cast("string"), F.lit(".html"))
    rows = catalog(spark, sf_dir).select("_seq", F.when(key % 2 == 0, link).otherwise(F.col("PRODUCT_SET_SID")).alias("line"))
    found = P.parse_lookup_inputs(rows, [("shop.co.ke", "KE"), ("shop.com.ng", "NG")])
    return found.select("input", "sku", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("country_hint", F.lit("")).alias("country"))


@query("choose_prices", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(CAST(p_size AS DOUBLE) AS VARCHAR)
  ELSE CAST(round(p_retailprice, 2) AS VARCHAR) END AS sale, sale AS regular FROM part""")
def choose_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("KSh "), F.format_number("p_retailprice", 2))).otherwise("").alias("SALE_PRICE"),
        F.concat(F.lit("KES "), F.col("p_size").cast("string")).alias("PRICE"))
    return P.choose_prices(rows).select("p_partkey", F.col("GLOBAL_SALE_PRICE").alias("sale"), F.col("GLOBAL_PRICE").alias("regular"))


@query("variation_list", """SELECT p_partkey, nullif(concat_ws(' | ', CASE WHEN p_size % 2 = 0 THEN 'Red' END, CASE WHEN p_size % 3 = 0 THEN 'S,M' END), '')
  AS variations FROM part""")
def variation_list(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN 'Red' ELSE 'nan' END AS COLOR",
                                                   "CASE WHEN p_size % 3 = 0 THEN 'S,M' END AS SIZES_AVAILABLE")
    return P.build_variation_list(rows).select("p_partkey", F.col("LIST_VARIATIONS").alias("variations"))


@query("fill_missing_image", f"""WITH {S.raw()}
SELECT sid AS "PRODUCT_SET_SID", CASE WHEN COLOR IS NULL THEN '' ELSE 'c' END AS mark,
  coalesce(max(CASE WHEN partkey % 2 = 0 THEN MAIN_IMAGE END) OVER (PARTITION BY sid), '') AS "MAIN_IMAGE" FROM raw""")
def fill_missing_image(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    even = F.split_part(F.substring("PRODUCT_SET_SID", 2, 40), F.lit("-"), F.lit(1)).cast("long") % 2 == 0
    own = rows.select("PRODUCT_SET_SID", F.when(F.col("COLOR").isNull(), "").otherwise("c").alias("mark"))
    return P.fill_missing_image(own, rows.where(even).select("PRODUCT_SET_SID", "MAIN_IMAGE"))


@query("category_fallback", f"""WITH {S.raw()} SELECT sid AS "PRODUCT_SET_SID", CASE WHEN COLOR = 'Red' THEN 'path of ' || BRAND ELSE CATEGORY END AS "CATEGORY" FROM raw""")
def category_fallback(spark, sf_dir):
    rows = catalog(spark, sf_dir).select(
        "PRODUCT_SET_SID", F.when(F.col("COLOR") == "Red", "").otherwise(F.col("CATEGORY")).alias("CATEGORY"),
        F.concat(F.lit("path of "), "BRAND").alias("CATEGORY_PATH"))
    return P.category_fallback(rows).select("PRODUCT_SET_SID", "CATEGORY")


@query("unresolved_categories", f"""WITH {S.raw()} SELECT DISTINCT CATEGORY AS "CATEGORY" FROM raw WHERE COLOR IS NULL""")
def unresolved_categories(spark, sf_dir):
    code = F.when(F.col("COLOR").isNotNull(), F.substring_index("CATEGORY_CODE", ".", 1)).otherwise("open")
    return P.unresolved_categories(catalog(spark, sf_dir).select("CATEGORY", code.alias("CATEGORY_CODE")))


@query("resolved_count", f"""WITH {S.raw()} SELECT count(COLOR) AS resolved, count(*) AS total FROM raw""")
def resolved_count(spark, sf_dir):
    code = F.when(F.col("COLOR").isNotNull(), F.substring_index("CATEGORY_CODE", ".", 1)).otherwise("open")
    return P.resolved_count(catalog(spark, sf_dir).select(code.alias("CATEGORY_CODE")))


@query("filter_seller", f"""WITH {S.raw()} SELECT sid AS "PRODUCT_SET_SID", SELLER_NAME AS "SELLER_NAME" FROM raw
WHERE SELLER_NAME IN ('Supplier#000000003', 'Supplier#000000007')""")
def filter_seller(spark, sf_dir):
    from shelfcheck.operators.catalog import filter_values

    rows = catalog(spark, sf_dir).select("PRODUCT_SET_SID", "SELLER_NAME")
    return filter_values(rows, "SELLER_NAME", ["Supplier#000000003", "Supplier#000000007"])


@query("load_category_map", "SELECT CAST(p_partkey AS VARCHAR) AS code, p_type || ' / ' || p_name AS path, p_partkey AS seq FROM part")
def load_category_map(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, "part", "p_partkey", category_name="p_name", category_code="concat(p_partkey, '.0')",
                   Category_Path="concat(p_type, ' / ', p_name)")
    return rules.load_category_map(sheet).select("code", "path", "seq")


@query("load_category_names", """SELECT lower(p_name) AS name, CAST(max(p_partkey) AS VARCHAR) AS code FROM part GROUP BY 1
UNION ALL SELECT 'seg ' || p_size, CAST(min(p_partkey) AS VARCHAR) FROM part GROUP BY 1""")
def load_category_names(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, "part", "p_partkey", category_name="initcap(p_name)", category_code="concat(p_partkey, '.0')",
                   Category_Path="concat(p_type, ' / Seg ', p_size)")
    return rules.load_category_names(sheet)


@query("load_ng_rice", """SELECT lower(p_brand) AS brand, list_sort(list_append(list(DISTINCT 'seller ' || (p_size % 4)), 'x')) AS sellers,
  list_sort(list(DISTINCT CAST(p_size AS VARCHAR))) AS categories FROM part GROUP BY 1""")
def load_ng_rice(spark, sf_dir):
    sheet = table(spark, sf_dir, "part").selectExpr("p_brand AS Brand", "concat('Seller ', p_size % 4, ', X') AS Sellers", "concat(p_size, '.0') AS Cat")
    return rules.load_ng_rice(sheet).select("brand", "sellers", "categories")


@query("load_ng_tvs", """SELECT DISTINCT 'lg' AS brand, lower(s_name) AS seller FROM supplier WHERE s_suppkey % 2 = 0
UNION SELECT 'sony', lower(s_name) FROM supplier WHERE s_suppkey % 3 = 0""")
def load_ng_tvs(spark, sf_dir):
    sheet = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS Category", "CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS LG",
                                                        "CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, ' ') END AS Sony")
    return rules.load_ng_tvs(sheet)[1]


@query("load_ma_brands", """SELECT lower(p_brand) || ' ' || p_size AS brand,
  list_sort(coalesce(list(DISTINCT 'vendor ' || (p_partkey % 5)) FILTER (WHERE p_partkey % 3 = 0), []::VARCHAR[])) AS sellers FROM part GROUP BY 1""")
def load_ma_brands(spark, sf_dir):
    sheet = _sheet(spark, sf_dir, "part", "p_partkey", Restricted_Brand="concat(p_brand, ' ', p_size)",
                   Authorized_Vendors="CASE WHEN p_partkey % 3 = 0 THEN concat('Vendor ', p_partkey % 5) END")
    restricted, prohibited = rules.load_ma_brands(sheet)
    none = F.array().cast("array<string>").alias("sellers")
    return restricted.select("brand", "sellers").unionByName(prohibited.select("brand", none))


@query("load_keyword_list", "SELECT DISTINCT 'refurb' AS program, lower(p_name) AS keyword FROM part")
def load_keyword_list(spark, sf_dir):
    sheet = table(spark, sf_dir, "part").selectExpr("concat(' ', initcap(p_name)) AS Keywords")
    return rules.load_keyword_list(sheet, "refurb").select("program", "keyword")


@query("load_category_list", "SELECT DISTINCT 'books' AS program, CAST(p_size AS VARCHAR) AS code FROM part")
def load_category_list(spark, sf_dir):
    sheet = table(spark, sf_dir, "part").selectExpr("concat(p_size, '.0') AS Categories")
    return rules.load_category_list(sheet, "books").select("program", "code")
