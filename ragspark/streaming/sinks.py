"""Streaming sinks with idempotent keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ragspark.operators import catalog as C
from ragspark.operators.chunking import chunk_text
from ragspark.operators.embedding import Embedder, with_embedding


def history_sink(results: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append translated turns that pass the history guards to a Parquet table, each exactly once."""
    kept = results.where(C.history_error(F.col("source_text"), F.col("translated_text")).isNull())
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def chunk_sink(docs: DataFrame, embedder: Embedder, path: str, checkpoint: str) -> DataStreamWriter:
    """Chunk and embed arriving documents; (document_id, ordinal) makes a replayed batch harmless."""
    rows = with_embedding(chunk_text(docs, "document_id", "text"), embedder)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def observe(table: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Publish the view again whenever the streamed table changes."""
    return table.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("update")


def live_turns(transcripts: DataFrame, translate: Callable, source: str, target: str, provider: str) -> DataFrame:
    """Final transcripts to history rows: trimmed, translated, blank results dropped."""
    from ragspark.functions import text as T

    final = transcripts.where("kind = 'Final'").withColumn("source_text", T.trim_all(F.col("text"))).where("source_text != ''")
    done = final.withColumn("translated_text", translate(F.col("source_text")))
    return done.where(~T.is_blank(F.col("translated_text"))).select(
        *[c for c in transcripts.columns if c not in ("text", "kind")], "source_text", "translated_text",
        F.lit(source).alias("source_language"), F.lit(target).alias("target_language"), F.lit(provider).alias("provider"),
    )
