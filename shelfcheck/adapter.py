"""Product listings derived from the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = "ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD"
NOUNS = "anvil,bolt,gear,gizmo,plate,ring,rod,widget"
ADJECTIVES = "blue,cold,hot,large,new,old,red,small"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_columns():
    name, ptype, key, size = F.col("p_name"), F.col("p_type"), F.col("p_partkey"), F.col("p_size")
    noun, adjective = F.split_part(name, F.lit(" "), F.lit(2)), F.split_part(name, F.lit(" "), F.lit(1))
    text = F.lit
    suffix = (
        F.when(size % 5 == 0, F.concat(text(" "), size.cast("string"), text("kg")))
        .when(size % 5 == 1, F.concat(text(" "), (size * 4).cast("string"), text("gb")))
        .when(size % 5 == 2, " tester")
        .when(size % 5 == 3, " best price BUY NOW")
        .otherwise("")
    )
    full_name = F.when(key % 17 == 0, name).otherwise(
        F.concat(
            name, text(" "), F.lower(ptype), suffix,
            F.when(key % 13 == 0, F.concat(text(" "), F.col("p_brand"))).otherwise(""),
        )
    )
    code = (
        F.lit(1000000)
        + F.instr(F.lit(TYPES), ptype) * 10000
        + F.instr(F.lit(NOUNS), noun) * 100
        + F.instr(F.lit(ADJECTIVES), adjective)
    )
    brand = F.when(key % 7 == 0, "Generic").when(key % 11 == 0, "Fashion").otherwise(F.col("p_brand"))
    path = F.concat(ptype, text(" > "), noun, text(" > "), adjective)
    return full_name, brand, path, code


def catalog(spark: SparkSession, sf_dir: str, description: bool = False) -> DataFrame:
    """One row per listing line; ``_seq`` orders the rows as a file would."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    sellers = table(spark, sf_dir, "supplier")
    full_name, brand, path, code = part_columns()
    line = F.col("l_linenumber")
    part = F.col("l_partkey").cast("string")
    nation = F.col("s_nationkey") % 6
    # the parts join last, so that no shuffle of the lines carries their texts
    joined = items.join(sellers, items.l_suppkey == sellers.s_suppkey).join(parts, items.l_partkey == parts.p_partkey)
    cols = [
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("_seq"),
        F.concat(F.lit("P"), part, F.lit("-"), F.col("l_suppkey").cast("string")).alias("PRODUCT_SET_SID"),
        F.concat(F.lit("M"), part).alias("PARENTSKU"),
        full_name.alias("NAME"),
        brand.alias("BRAND"),
        path.alias("CATEGORY"),
        F.concat(code.cast("string"), F.when(line % 2 == 0, ".0").otherwise("")).alias("CATEGORY_CODE"),
        F.col("s_name").alias("SELLER_NAME"),
        F.concat(
            F.when(line % 3 == 0, "shop-").otherwise(""),
            F.when(nation == 0, "ke").when(nation == 1, "UG").when(nation == 2, "NG")
            .when(nation == 3, "GH").when(nation == 4, "MA").otherwise("Multiple"),
        ).alias("ACTIVE_STATUS_COUNTRY"),
        F.when(line != 7, F.col("p_retailprice")).alias("GLOBAL_PRICE"),
        F.when(
            line != 6, F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
        ).alias("GLOBAL_SALE_PRICE"),
        F.when(F.col("l_returnflag") == "R", "Red").when(F.col("l_returnflag") == "A", "n/a").alias("COLOR"),
        F.when(line == 1, "Blue").alias("COLOR_FAMILY"),
        F.when(F.col("l_linestatus") == "O", "Yes").alias("PRODUCT_WARRANTY"),
        F.when((F.col("l_linestatus") == "O") & (line % 2 == 1), "12 months").alias("WARRANTY_DURATION"),
        F.when(line % 4 == 0, line.cast("string")).alias("COUNT_VARIATIONS"),
        F.concat(
            F.lit("http://img.example.org/"), (F.col("l_partkey") % 100).cast("string"), F.lit(".png")
        ).alias("MAIN_IMAGE"),
    ]
    if description:
        docs = table(spark, sf_dir, "documents").select(
            F.col("doc_id"), F.col("text").alias("DESCRIPTION")
        )
        joined = joined.join(docs, joined.l_partkey == docs.doc_id, "left")
        cols.append(F.col("DESCRIPTION"))
    return joined.select(*cols)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category table (code, path) of the listing categories, one row per code."""
    _, _, path, code = part_columns()
    return (
        table(spark, sf_dir, "part")
        .select(code.cast("string").alias("code"), path.alias("path"))
        .groupBy("code")
        .agg(F.min("path").alias("path"))
        .select("code", "path", F.col("code").cast("long").alias("seq"))
    )
