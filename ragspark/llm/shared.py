"""Session helpers: the shared checkpoint folder, models sent to executors and plain names for working columns."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spark_dir(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only a local session without that setting gets one of its own.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, its lineage gone."""
    spark_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(context: SparkContext, model: Any) -> Broadcast:
    """A broadcast of ``model`` with the code of its classes, so that executors need not have the package."""
    return context.broadcast(cloudpickle.dumps(model))


def opened(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_null(docs: DataFrame, name: str = "text") -> Column:
    """The text column as a string, whatever its type."""
    return docs[name].cast("string")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again; a new path each time."""
    spark = df.sparkSession
    spark_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
