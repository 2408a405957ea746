"""Writers: report exports, split files, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.constants import FULL_DATA_COLS, REPORT_COLS, SPLIT_LIMIT
from shelfcheck.functions.text import pystr, repair_mojibake, strip
from shelfcheck.plans.preqc import category_paths, number_rows
from shelfcheck.sources.rules import RuleSet

SID = "PRODUCT_SET_SID"


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """The given columns in order; a missing one is NULL, text is repaired."""
    types = dict(df.dtypes)
    out = []
    for c in cols:
        if c not in types:
            out.append(F.lit(None).cast("string").alias(c))
        else:
            out.append((repair_mojibake(f"`{c}`") if types[c] == "string" else F.col(f"`{c}`")).alias(c))
    return df.select(*out)


def export_report(report: DataFrame, kind: str = "all") -> DataFrame:
    if kind != "all":
        report = report.filter(F.col("Status") == {"rejected": "Rejected", "approved": "Approved"}[kind])
    return project(report, REPORT_COLS)


def merge_full(df: DataFrame, report: DataFrame, rules: RuleSet) -> DataFrame:
    """Product data with the decision columns and the full category path."""
    decided = report.select(
        strip(pystr("ProductSetSid")).alias("_sid"), "Status", "Reason", "Comment",
        F.col("FLAG").alias("_flag"), "SellerName",
    )
    rows = df.drop("FLAG", "FULL_CATEGORY_PATH")
    if rules.has("category"):
        paths = category_paths(rules)
        rows = rows.join(paths, strip(pystr("CATEGORY_CODE")) == paths["_code"], "left").withColumn(
            "FULL_CATEGORY_PATH", F.coalesce("_full", F.lit(""))
        ).drop("_code", "_full")
    else:
        rows = rows.withColumn("FULL_CATEGORY_PATH", F.lit(""))
    return rows.join(decided, strip(pystr(SID)) == F.col("_sid"), "left").drop("_sid").withColumnRenamed("_flag", "FLAG")


def export_full(df: DataFrame, report: DataFrame, rules: RuleSet) -> DataFrame:
    cols = FULL_DATA_COLS + [c for c in ("Status", "Reason", "Comment", "SellerName") if c not in FULL_DATA_COLS]
    return project(merge_full(df, report, rules), cols)


def split_parts(df: DataFrame, order: list[Column], size: int = SPLIT_LIMIT) -> DataFrame:
    """File number (from 1) so that every file but the last holds exactly ``size`` rows."""
    numbered = number_rows(df, order, "_row")
    return numbered.withColumn("part", (F.floor(F.col("_row") / size) + 1).cast("long")).drop("_row")


def write_split(df: DataFrame, order: list[Column], path: str, size: int = SPLIT_LIMIT) -> None:
    """One folder per part, rows in order."""
    parts = split_parts(df, order, size)
    parts.repartitionByRange("part").sortWithinPartitions("part", *order).write.partitionBy("part").option(
        "header", True
    ).csv(path)


def export_post_qc(df: DataFrame, report: DataFrame) -> DataFrame:
    """Live listings with FINAL_FLAG and FLAG_REASON ('ok' when approved); internal columns dropped."""
    decided = report.select(F.col("ProductSetSid").alias("_sid"), "Status", F.col("FLAG").alias("_f"), "Comment")
    ok = F.coalesce("Status", F.lit("Approved")) == "Approved"
    shown = [F.col(f"`{c}`") for c in df.columns if not c.startswith("_")]
    return df.join(decided, df[SID] == decided["_sid"], "left").select(
        *shown,
        F.when(ok, "ok").otherwise(F.coalesce("_f", F.lit("Rejected"))).alias("FINAL_FLAG"),
        F.when(ok, "ok").otherwise(F.coalesce("Comment", F.lit(""))).alias("FLAG_REASON"),
    )


def write_executive(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("error").option("header", True).csv(f"{path}/{name}")


def write_csv_bom(df: DataFrame, path: str) -> None:
    """CSV that starts with a byte-order mark, carried by the first header name."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
