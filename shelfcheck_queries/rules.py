"""Rule tables for the registered queries: derived from the given tables, plus a few literal rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.adapter import categories, part_columns, table
from shelfcheck.sources.rules import SCHEMAS, RuleSet, small_table

MARKET = "Shop"

# list -> condition on the category path (valid in Spark SQL and DuckDB)
CODE_LISTS = {
    "fashion": "path LIKE 'PROMO > %'",
    "weight": "path LIKE '% > bolt > %' OR path LIKE '% > rod > %'",
    "smartphones": "path LIKE '% > gizmo > %'",
    "warranty": "path LIKE '% > gear > %'",
    "color": "path LIKE '% > widget > %' OR path LIKE '% > plate > %'",
    "sneakers": "path LIKE '% > rod > %'",
    "duplicate_exempt": "path LIKE '% > anvil > %'",
    "variation": "path LIKE '% > small'",
    "books": "path LIKE '% > plate > %'",
}
PROGRAM_CODES = {
    "perfume": "path LIKE '% > ring > %'",
    "jersey": "path LIKE '% > widget > %'",
    "refurb_phones": "path LIKE '% > gizmo > %'",
    "refurb_laptops": "path LIKE '% > gear > %'",
    "ng_gift_card": "path LIKE '% > anvil > %'",
    "ng_hp_toner": "path LIKE '% > bolt > %'",
    "ng_tv": "path LIKE '% > gizmo > %'",
    "powerbank": "path LIKE '% > gizmo > old' OR path LIKE '% > gizmo > new'",
}
# program -> approved sellers, as a condition on the supplier table
SELLERS = {
    "books": "s_suppkey % 3 = 0",
    "perfume": "s_suppkey % 4 = 1",
    "refurb_phones": "s_suppkey % 2 = 0",
    "refurb_laptops": "s_suppkey % 5 = 0",
    "jersey_exempt": "s_suppkey % 7 = 0",
    "ng_gift_card": "s_suppkey % 2 = 1",
    "ng_hp_toner": "s_suppkey % 3 = 1",
    "ng_apple": "s_suppkey % 4 = 0",
    "ng_xmas": "s_suppkey % 5 = 1",
}
WORDS = {
    "unnecessary": ["best price", "buy now", "promo"],
    "blacklisted": ["tester", "economy", "old rod"],
    "colors": ["red", "blue", "dark red", "gold", "navy"],
    "known_brands": ["red ring", "hot gear", "hot", "blue", "large-plate", "old bolt"],
    "sneaker_brands": ["small", "hot r", "new"],
}
KEYWORDS = {
    "refurb": ["old", "old gizmo", "hot"],
    "perfume": ["brand#3", "hot ring", "cold", "new"],
    "jersey": ["red widget", "blue", "promo"],
    "ng_xmas": ["gear", "red ring", "tester"],
}
# rule_seq, keyword, categories
PROHIBITED = [
    (1, "anvil", []),
    (2, "old anvil", []),
    (3, "hot", ["1013602", "1010112", "1080112"]),
    (4, "red widget", []),
    (5, "tester", ["1010101"]),
    (6, "rod economy", []),
]
# rule_seq, brand, brand_raw, sellers, categories, variations
RESTRICTED = [
    (1, "brand#2", "Brand#2", ["supplier#000000001", "supplier#000000004"], [], ["red ring"]),
    (2, "hot", "Hot", [], ["1013602", "1013612"], []),
    (3, "cold gear", "Cold Gear", ["supplier#000000002"], [], ["old gear", "gear"]),
    (4, "brand#12", "Brand#12", [], [], []),
    (5, "gizmo", "Gizmo", ["supplier#000000003"], [], ["brand#7"]),
]
# rule_seq, title, seller
NG_BOOKS = [
    (1, "hot bolt", None),
    (2, "olt sm", "supplier#000000044"),
    (3, "bolt", "supplier#000000002"),
    (4, "ring", "supplier#000000008"),
]
NG_TV = [("brand#1", "supplier#000000002"), ("brand#1", "supplier#000000003"), ("brand#4", "supplier#000000005")]
NG_RICE = [
    ("brand#5", ["supplier#000000002", "supplier#000000008"], []),
    ("brand#6", [], ["1010112", "1013001", "1013012"]),
    ("fashion", ["supplier#000000003"], []),
]
POWERBANK_BRANDS = ["brand#1", "brand#2", "generic"]
MA_BRANDS = ["brand#9", "cold rod", "fashion"]
# Parent categories that own a cap, and further caps by code.
PARENTS = [("2000001", "LARGE > bolt", 1), ("2000002", "MEDIUM", 2), ("2000003", "SMALL > ring", 3)]
PARENT_CAPS = [("KE", "2000001", 150000.0), ("KE", "2000002", 200000.0), ("KE", "2000003", 130000.0)]
LEVEL1 = [("ECONOMY", 1200.0), ("STANDARD", 950.0)]


def code_lists(cat: DataFrame, lists: dict[str, str], name: str) -> DataFrame:
    """Long (list, code) table: one row per list whose condition the path meets."""
    tags = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(n)) for n, cond in lists.items()]))
    return cat.select(F.explode(tags).alias(name), "code")


_PINNED: dict[tuple[str, str], RuleSet] = {}


def rule_set(spark: SparkSession, sf_dir: str) -> RuleSet:
    """Rule tables of one data set, written once per session as rule files would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PINNED:
        _PINNED[key] = build_rules(spark, sf_dir).pin()
    return _PINNED[key]


def build_rules(spark: SparkSession, sf_dir: str) -> RuleSet:
    cat = categories(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier")
    _, _, _, code = part_columns()
    part = table(spark, sf_dir, "part")
    literal = lambda rows, name: small_table(spark, rows, SCHEMAS[name])
    category = cat.unionByName(literal(PARENTS, "category"))
    programs = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in SELLERS.items()]))
    tables = {
        "code_list": code_lists(cat, CODE_LISTS, "list_name"),
        "program_category": code_lists(cat, PROGRAM_CODES, "program"),
        "word_list": literal([(n, w) for n, ws in WORDS.items() for w in ws], "word_list"),
        "program_keyword": literal([(None, n, w) for n, ws in KEYWORDS.items() for w in ws], "program_keyword"),
        "prohibited": literal([(None, s, k, c) for s, k, c in PROHIBITED], "prohibited"),
        "restricted_brand": literal([(None, *r) for r in RESTRICTED], "restricted_brand"),
        "seller_allow": supplier.select(
            F.lit(None).cast("string").alias("country"), F.explode(programs).alias("program"),
            F.lower("s_name").alias("seller"),
        ),
        "fake_price": part.filter("p_partkey % 5 = 0").groupBy(
            F.lower("p_brand").alias("brand"), code.cast("string").alias("category")
        ).agg(F.max("p_retailprice").alias("min_price")).select(
            F.lit(None).cast("string").alias("country"), "brand", "category", "min_price"
        ),
        "ng_book": literal(NG_BOOKS, "ng_book"),
        "ng_tv": literal(NG_TV, "ng_tv"),
        "ng_rice": literal(NG_RICE, "ng_rice"),
        "powerbank_brand": literal([(b,) for b in POWERBANK_BRANDS], "powerbank_brand"),
        "ma_brand": literal([(b,) for b in MA_BRANDS], "ma_brand"),
        "category": category,
        "price_cap": cat.filter("CAST(code AS BIGINT) % 3 = 0").select(
            F.lit("KE").alias("country"), "code", F.lit(140000.0).alias("cap_local")
        ).unionByName(literal(PARENT_CAPS, "price_cap")),
        "level1_cap": literal(LEVEL1, "level1_cap"),
    }
    return RuleSet(spark, tables, MARKET)
