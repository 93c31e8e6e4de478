"""Web evidence: normalising fetched results, trust rules and provider failover.  No network access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T
from ragspark.functions import urls as U

ENCYCLOPEDIA_SCHEMA = "query struct<pages:array<struct<title:string,extract:string,fullurl:string,pageid:bigint>>>"
SEARCH_SCHEMA = "web struct<results:array<struct<title:string,url:string,description:string>>>"


def body_within_limit(body: Column, declared: Column | None = None, limit: int = X.WEB_BODY_BYTES) -> Column:
    """Neither the declared nor the actual byte length exceeds the limit (unknown = -1 or null)."""
    actual = F.octet_length(body) <= limit
    return actual if declared is None else actual & (F.coalesce(declared, F.lit(-1)) <= limit)


def query_error(query: Column) -> Column:
    """Null for a usable query, otherwise the reason."""
    low, high = X.WEB_QUERY_CHARS
    n = F.length(T.trim_all(query))
    return F.when((n < low) | (n > high), f"Web search query must be between {low} and {high} characters")


def result_limit(limit: Column) -> Column:
    return F.least(F.greatest(limit, F.lit(1)), F.lit(X.WEB_MAX_RESULTS))


def _filled(c: Column) -> Column:
    return ~T.is_blank(F.coalesce(c, F.lit("")))


def _time(retrieved: Column | None) -> list[Column]:
    return [] if retrieved is None else [F.coalesce(retrieved.cast("bigint"), F.lit(0).cast("bigint")).alias("retrieved_ms")]


def encyclopedia_evidence(rows: DataFrame, page_id: str, title: str, extract: str, url: str, keep: list[str] = (),
                          host: str = U.ENCYCLOPEDIA_HOST, retrieved: Column | None = None) -> DataFrame:
    """Evidence from encyclopedia results; rows without id, title, extract or a trusted URL drop out.

    ``retrieved`` (milliseconds), if given, becomes ``retrieved_ms``; unknown times are 0.
    """
    content, link = T.trim_all(F.col(extract)), T.trim_all(F.col(url))
    return rows.where(
        F.col(page_id).isNotNull() & _filled(F.col(title)) & _filled(content) & U.is_trusted_host(link, host)
    ).select(
        *keep,
        T.trim_all(F.col(title)).alias("title"), link.alias("url"),
        T.take_chars(T.collapse_spaces(content), X.WEB_EXCERPT_CHARS).alias("excerpt"),
        T.take_chars(content, X.WEB_CONTENT_CHARS).alias("content"),
        F.lit("Wikipedia").alias("provider"),
        F.concat(F.lit("wikipedia:"), F.col(page_id).cast("string")).alias("source_id"), *_time(retrieved),
    )


def search_evidence(rows: DataFrame, title: str, description: str, url: str, keep: list[str] = (),
                    retrieved: Column | None = None) -> DataFrame:
    """Evidence from web search results; markup stripped, unsafe URLs and blank fields drop out; ``retrieved`` as above."""
    link, text = T.trim_all(F.col(url)), T.strip_tags(F.col(description))
    cleaned = rows.select(*keep, *_time(retrieved), F.col(title).alias("_title"), link.alias("_url"), text.alias("_text"))
    return cleaned.where(_filled(F.col("_title")) & _filled(F.col("_text")) & U.is_safe_https(F.col("_url"))).select(
        *keep,
        T.take_chars(T.trim_all(F.col("_title")), X.WEB_TITLE_CHARS).alias("title"), F.col("_url").alias("url"),
        T.take_chars(F.col("_text"), X.WEB_EXCERPT_CHARS).alias("excerpt"),
        T.take_chars(F.col("_text"), X.WEB_CONTENT_CHARS).alias("content"),
        F.lit("Brave Search").alias("provider"),
        F.concat(F.lit("brave:"), T.stable_id(F.col("_url"))).alias("source_id"), *([] if retrieved is None else ["retrieved_ms"]),
    )


def _items(payloads: DataFrame, body: str, keep: list[str], schema: str, path: str, failed: str) -> DataFrame:
    """``item, error`` of every result in JSON bodies, each body parsed once.

    A body over the limit, a null one and one that is not JSON of the schema give one row with an ``error`` and no item;
    a body without results gives no row.
    """
    within = F.coalesce(body_within_limit(F.col(body)), F.lit(True))
    parsed = F.from_json(F.when(within, F.col(body)), f"{schema}, _rest string", {"columnNameOfCorruptRecord": "_rest"})
    checked = payloads.select(*keep, within.alias("_within"), parsed.alias("_parsed"))
    error = F.when(~F.col("_within"), X.WEB_BODY_TOO_LARGE).when(
        F.col("_parsed").isNull() | F.col("_parsed._rest").isNotNull(), failed)
    items = F.col(f"_parsed.{path}")
    kind = checked.select(items).schema[0].dataType
    none = F.array(F.lit(None).cast(kind.elementType))
    rows = checked.select(*keep, error.alias("error"), F.when(error.isNotNull(), none).otherwise(items).alias("_items"))
    return rows.select(*keep, F.explode("_items").alias("item"), "error")


def parse_encyclopedia(payloads: DataFrame, body: str, keep: list[str] = ()) -> DataFrame:
    """Result rows from JSON bodies; unknown keys are ignored, a body that cannot be used gives one row with an ``error``."""
    rows = _items(payloads, body, list(keep), ENCYCLOPEDIA_SCHEMA, "query.pages", X.ENCYCLOPEDIA_FAILED)
    title = F.when(F.col("error").isNull(), F.coalesce("item.title", F.lit("")))
    return rows.select(*keep, title.alias("title"), "item.extract", F.col("item.fullurl").alias("url"), F.col("item.pageid").alias("page_id"), "error")


def parse_search(payloads: DataFrame, body: str, keep: list[str] = ()) -> DataFrame:
    """Result rows of web search bodies; errors as in ``parse_encyclopedia``."""
    rows = _items(payloads, body, list(keep), SEARCH_SCHEMA, "web.results", X.SEARCH_FAILED)
    return rows.select(*keep, "item.title", "item.url", "item.description", "error")


def failover(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Per request, all rows of the first provider that returned any.

    Which requests the primary answered is one row per request, so a request with many rows is an
    ordinary skewed join and is split by adaptive execution.
    """
    answered = primary.select(*keys).distinct()
    return primary.unionByName(secondary.join(answered, keys, "left_anti"))


def failover_outcome(
    primary_error: Column, primary_rows: Column, secondary_ready: Column, secondary_error: Column, secondary_rows: Column,
) -> Column:
    """``struct<source,error>``: which provider's result stands, and its error if that is one."""
    p_ok = primary_error.isNull()
    consult = ~(p_ok & (primary_rows > 0)) & secondary_ready
    s_wins = consult & F.when(secondary_error.isNull(), secondary_rows > 0).otherwise(~p_ok)
    return F.struct(
        F.when(s_wins, "SECONDARY").otherwise("PRIMARY").alias("source"),
        F.when(s_wins, secondary_error).otherwise(primary_error).alias("error"),
    )


def availability(error: Column, is_io_error: Column, configured: Column) -> Column:
    """Provider availability after a call."""
    return (
        F.when(~configured, "NOT_CONFIGURED").when(error.isNull(), "AVAILABLE")
        .when(is_io_error, "OFFLINE").otherwise("UNAVAILABLE")
    )


def replace_status(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` with updated columns where ``updates`` has the key; unknown keys are ignored."""
    rest = [c for c in current.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_hit"))
    return current.join(new, key, "left").select(
        key, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    )


def top_results(evidence: DataFrame, keys: list[str], order: list[str], limit: int = X.WEB_LIMIT) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return evidence.withColumn("position", F.row_number().over(first)).where(F.col("position") <= limit)
