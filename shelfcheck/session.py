"""Session settings and materialisation."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []

CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="shelfcheck-"))
    return _LOCAL_DIR[0]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a result that several branches read, and read it back as a table.

    The table cuts the lineage, survives lost executors and lets every reader
    prune columns, which a cached row store would not.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """Like ``materialize``, dealt into buckets by a key: readers that group or join by it shuffle only the other side.

    The shuffle files of the writing are let go before anything reads the table.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_dir(spark).rstrip('/')}/{table}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    release(spark)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written; Spark deletes them only after the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Use every core for per-row heavy work on an input of fewer splits than cores.

    Large inputs have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
