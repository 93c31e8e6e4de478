"""The corpus pipeline: documents in, token ids of clean, distinct documents out.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last keep the columns of
``documents``:

1. language ID rejects documents without a letter and those that fall short of the score that texts of the learned
   languages reach (see ``langid.accepted``);
2. line dedup takes out lines that at least 10 documents share, all but the first line of the first of these
   documents (in the order of the ids as text); ``n_chars`` is counted anew;
3. SimHash near-dedup keeps the document with the smallest id of every group;
4. decontamination drops documents of which a twentieth or more lies in benchmark passages, and cuts the benchmark
   passages out of the others;
5. SentencePiece encoding returns ``doc_id, n_pieces, ids, round_trip``.

Null texts and texts without a letter end at the first stage.  Texts that lose all their lines are empty and meet as
one empty document.  Null and repeated ids lose no row: groups and passages are told by (id, text), and of rows equal
in both one stays.  Empty tables give empty results; extra columns pass whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragspark.llm import decontaminate, langid, linededup, pieces, simhash
from ragspark.llm.registry import table
from ragspark.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(docs, min_docs=10, keep_first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# learned models and shortest-path searches are not SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
