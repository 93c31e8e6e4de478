"""Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rebalance rows when the scan gives fewer splits than the cluster has cores.

    Meant for a table scan just before heavy per-row work.  Large tables have enough splits and pass
    through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; without a configured one, as in tests, in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a new table in the shared folder and read again: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_document(df: DataFrame, path: str, key: str = "document_id", buckets: int = 256) -> None:
    """Write rows under ``bucket=`` folders of their document, for pruned reads of single documents.

    A bucket is spread over tasks by ordinal range, so one large document does not become one file.
    Always a new path: a plan must not overwrite what it reads.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    (
        df.withColumn("bucket", bucket).withColumn("_spread", F.floor(F.col("ordinal") / 4096))
        .repartition("bucket", "_spread").drop("_spread").write.partitionBy("bucket").parquet(path)
    )


def read_document(spark: SparkSession, path: str, document_id, key: str = "document_id", buckets: int = 256) -> DataFrame:
    """Point lookup: one bucket folder, then a pushed-down key filter."""
    table = spark.read.parquet(path)
    literal = F.lit(document_id).cast(table.schema[key].dataType)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(literal), F.lit(buckets)).cast("int").alias("b")).first()["b"]
    return table.where((F.col("bucket") == bucket) & (F.col(key) == literal)).drop("bucket")
