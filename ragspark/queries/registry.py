"""Registry of runnable queries, each with the DuckDB SQL that must give the same rows.

A query takes ``(spark, folder)``, reads whole tables and returns a DataFrame.  A query without SQL is
one whose result SQL cannot state; its rows are checked against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.operators.ordered import Ordering, range_bucket
from ragspark.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY_MS = 86_400_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Result columns in the oracle's types: whole numbers as bigint, floats as double to six digits."""
    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.round(c.cast("double"), 6).alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents spread over the cores before text work."""
    return spread(read_table(spark, folder, "documents"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-free timestamp, whatever the session time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def events(spark: SparkSession, folder: str) -> tuple[DataFrame, Ordering]:
    """Events with ``ts_ms``, ordered per user, a user split by day."""
    rows = read_table(spark, folder, "events").withColumn("ts_ms", epoch_ms(F.col("ts")))
    return rows.withColumn("_bucket", range_bucket(F.col("ts_ms"), DAY_MS)), Ordering(("user_id",), ("ts_ms", "event_id"))


# SQL fragments shared by oracles ------------------------------------------------------------

WS = r"[\p{Z}\x09-\x0D\x1C-\x1F]+"
WS_TRIM = r"^[\p{Z}\x09-\x0D\x1C-\x1F]+|[\p{Z}\x09-\x0D\x1C-\x1F]+$"
PRE = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\x0B\f\r]"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '{WS_TRIM}', '', 'g')"


SQL_TOKENS = f"""toks AS (
  SELECT doc_id, source, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS t FROM documents)"""


def sql_chunks(size: int = 512, overlap: int = 50) -> str:
    step = size - overlap
    return f"""{SQL_TOKENS}, chunks AS (
  SELECT doc_id, i AS ordinal, array_to_string(t[i*{step}+1 : least(i*{step}+{size}, len(t))], ' ') AS text,
         i*{step} AS start_token, least(i*{step}+{size}, len(t)) AS end_token
  FROM toks, LATERAL unnest(range(0, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= {size} THEN 1
       ELSE 1 + CAST(ceil((len(t) - {size}) / {step}.0) AS BIGINT) END)) u(i))"""


def sql_id_windows() -> str:
    """Ids ``ids(doc_id, ordinal, a)`` of the chunks and their windows ``w(doc_id, ordinal, window_no, part)`` of 62."""
    return """ids AS (SELECT doc_id, ordinal, list_transform(string_split(text, ' '), lambda x: CAST('0x' || substr(md5(x), 1, 6) AS BIGINT) % 30000 + 1000) AS a FROM chunks),
w AS (SELECT doc_id, ordinal, i AS window_no, a[i*62+1 : i*62+62] AS part FROM ids,
  LATERAL unnest(range(0, greatest(1, CAST(ceil(len(a) / 62.0) AS BIGINT)))) u(i))"""


def word_ids(text: Column) -> Column:
    """The same ids of a chunk's words."""
    return F.transform(F.split(text, " "), lambda x: F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("bigint") % 30000 + 1000)


def sql_vectors(name: str, source: str, keys: str, dim: int = 64) -> str:
    """Sparse hashed bag-of-words vectors ``name(keys, b, v)`` and norms ``name_n(keys, n)``."""
    return f"""{name}_c AS (
  SELECT {keys}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS b, count(*) AS c
  FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '{PRE}')) AS w FROM {source}) GROUP BY ALL),
{name} AS (SELECT {keys}, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS FLOAT) AS DOUBLE) AS v FROM {name}_c),
{name}_n AS (SELECT {keys}, sqrt(sum(v * v)) AS n FROM {name} GROUP BY ALL)"""


SQL_HITS = f"""{sql_chunks()}, {sql_vectors('cv', 'chunks', 'doc_id, ordinal')},
{sql_vectors('qv', '(SELECT item_id, text FROM benchmark)', 'item_id')},
pairs AS (
  SELECT q.item_id, c.doc_id, c.ordinal, sum(q.v * c.v) AS dot FROM qv q JOIN cv c USING (b) GROUP BY ALL),
every AS (
  SELECT qn.item_id, cn.doc_id, cn.ordinal,
    CAST(least(1, greatest(-1, coalesce(p.dot, 0) / (qn.n * cn.n))) AS FLOAT) AS score
  FROM qv_n qn CROSS JOIN cv_n cn LEFT JOIN pairs p USING (item_id, doc_id, ordinal)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ordinal) AS rank
  FROM every QUALIFY rank <= 5)"""
