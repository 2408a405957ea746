"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcheck.session import materialize, work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, in Java's and Python's pattern syntax.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_SPACE_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    return materialize(df, name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name, as a URI, under the folder that driver and executors share."""
    base = work_dir(spark).rstrip("/")
    return f"{base if ':/' in base else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, gap: str = NON_WORD) -> Column:
    """Lower-cased words of a text between runs of ``gap``; no empty words; null text has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), gap), "")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, salts: int = 1024) -> DataFrame:
    """Adds ``out``, a gapless number from 0 within ``keys``.

    No task gets a whole group: rows are numbered within (keys, salt), where the salt comes from the order
    columns, and prefix sums of the counts by salt shift them. ``df`` is read twice, so pass a written table.
    Keys are never null. Rows equal in all order columns are numbered in any order.
    """
    salted = df.withColumn("_llm_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    within = Window.partitionBy(*keys, "_llm_salt").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_llm_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*keys, "_llm_salt").agg(F.count("*").alias("_llm_n"))
    shifts = counts.select(*keys, "_llm_salt", F.coalesce(F.sum("_llm_n").over(before), F.lit(0)).alias("_llm_shift"))
    local = salted.withColumn("_llm_row", F.row_number().over(within).cast("long") - 1)
    return local.join(shifts, [*keys, "_llm_salt"]).withColumn(out, F.col("_llm_row") + F.col("_llm_shift")).drop(
        "_llm_salt", "_llm_row", "_llm_shift")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
