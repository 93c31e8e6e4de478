from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for themselves
    T.StructField("_text", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("score", T.DoubleType()),
])


@pytest.fixture
def make(spark):
    """A documents table with clashing extra columns from (doc_id, text) or (doc_id, text, lang) rows."""
    def build(rows, partitions: int = 3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 1, 0.5) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return build


@pytest.fixture
def odd(make):
    """Null and empty texts, null and repeated ids, repeated rows, white space, a long text."""
    return make([
        (1, None), (2, ""), (3, " \t\n\n "), (None, "no id here"), (None, None), (4, "same row"), (4, "same row"),
        (4, "same id, other text"), (5, "ünïcode ▁ mark  and\r\nlines\n"), (6, "long words " * 30_000 + "x" * 5000),
    ])
