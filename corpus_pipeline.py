"""Corpus pipeline: quality, near duplicates, benchmark contamination, secrets, packing.

Each stage is a function of (spark, docs, sf_dir). ``run`` applies them to the documents, writes what each returns
as Parquet in the shared folder and gives it to the next one. All but the last return the columns of documents.

In every stage null texts are empty, texts count whole however long they are, columns beyond those read are kept as
they are (own columns carry names beginning with ``_llm``), and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.llm import packing, quality, secret_scan, simhash, winnow
from shelfcheck.llm.common import saved, table
from shelfcheck.llm.queries import GOOD, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores as good. Equal texts have equal scores; repeated rows all stay or all go."""
    net = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, net, out="_llm_quality").where(F.col("_llm_quality") >= GOOD).drop("_llm_quality")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Null and empty texts and texts without words are one group. Of rows with equal ids and texts one stays; a null id
    stays only in a group without any other. Very long texts count whole. No documents, none kept.
    """
    return simhash.one_of_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark. Empty texts are clean; repeated rows all stay or all go."""
    return winnow.clean_of(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced; n_chars follows where the text changed. A null text stays null."""
    safe = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        safe = safe.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return safe.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset. An empty text is its end id alone; repeated rows are each packed."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("byte CNN quality", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("winnowing decontamination", decontamination_stage),
    ("assignment secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The network's score cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
