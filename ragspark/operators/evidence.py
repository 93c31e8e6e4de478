"""From ranked hits to a grounded answer: context, routing, citations, terminal events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T

PART_EVENTS = 1024


def is_relevant(score: Column, minimum: float = X.MIN_SCORE) -> Column:
    """``score >= minimum`` in float32, with NaN (greatest in SQL) and null excluded."""
    s = score.cast("float")
    return F.coalesce(~F.isnan(s) & (s >= F.lit(minimum).cast("float")), F.lit(False))


def relevant(hits: DataFrame, query_cols: list[str], minimum: float = X.MIN_SCORE, limit: int = X.CONTEXT_LIMIT,
             rank_col: str = "rank") -> DataFrame:
    """Relevant hits per query, best score first, input rank deciding ties, at most ``limit``."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    best = Window.partitionBy(*query_cols).orderBy(F.desc("score"), rank_col)
    return (
        hits.where(is_relevant(F.col("score"), minimum))
        .withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)
    )


def source_id(document: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("local:"), document.cast("string"), F.lit(":"), ordinal.cast("string"))


def _greedy(items: Column, max_chars: Column) -> Column:
    """Fold ranked ``struct<header,text>`` into the parts that fit.

    A header that does not fit is skipped, not terminal; text is cut to what is left; blank excerpts
    are skipped; a separator costs two characters after the first part.
    """
    start = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<int>").alias("kept")
    )

    def step(acc: Column, item: Column) -> Column:
        separator = F.when(F.size(acc["parts"]) == 0, 0).otherwise(2)
        left = max_chars - acc["used"] - separator - F.length(item["header"])
        excerpt = T.take_chars(item["text"], F.greatest(left, F.lit(0)))
        fits = (left > 0) & ~T.is_blank(excerpt)
        return F.when(fits, F.struct(
            (acc["used"] + separator + F.length(item["header"]) + F.length(excerpt)).alias("used"),
            F.concat(acc["parts"], F.array(F.concat(item["header"], excerpt))).alias("parts"),
            F.concat(acc["kept"], F.array(item["position"])).alias("kept"),
        )).otherwise(acc)

    return F.aggregate(items, start, step)


def build_context(
    hits: DataFrame, query_cols: list[str], minimum: float = X.MIN_SCORE, limit: int = X.CONTEXT_LIMIT,
    max_chars: int | str = X.CONTEXT_CHARS, document_col: str = "document_id", name_col: str = "document_name",
    rank_col: str = "rank",
) -> DataFrame:
    """``query ids, context, used_chars, evidence, status`` for queries with at least one relevant hit.

    Status is OK or BUDGET_EXCEEDED; queries missing here have NO_EVIDENCE (see ``with_status``).
    The gathered group is at most ``limit`` hits per query.  ``max_chars`` is a number, or the name of an
    integer column of ``hits`` that holds the budget of each query.
    """
    if isinstance(max_chars, int) and max_chars <= 0:
        raise ValueError("max_chars must be positive")
    budget = F.lit(max_chars) if isinstance(max_chars, int) else F.max(max_chars)
    sid = source_id(F.col(document_col), F.col("ordinal"))
    header = F.concat(F.lit("["), sid, F.lit("] "), F.col(name_col), F.lit("#"), F.col("ordinal").cast("string"), F.lit("\n"))
    item = F.struct(
        F.col("position"), header.alias("header"), F.col("text").alias("text"), sid.alias("source_id"),
        F.col(name_col).alias("document_name"), F.col("ordinal").alias("ordinal"), F.col("score").alias("score"),
    )
    grouped = relevant(hits, query_cols, minimum, limit, rank_col).groupBy(*query_cols).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), budget.cast("int").alias("_budget")
    )
    folded = grouped.withColumn("_fold", _greedy(F.col("_items"), F.col("_budget")))
    parts = F.col("_fold.parts")
    return folded.select(
        *query_cols,
        F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).alias("context"),
        F.col("_fold.used").alias("used_chars"),
        F.filter("_items", lambda i: F.array_contains(F.col("_fold.kept"), i["position"])).alias("evidence"),
        F.when(F.size(parts) > 0, "OK").otherwise("BUDGET_EXCEEDED").alias("status"),
    )


def with_status(queries: DataFrame, contexts: DataFrame, query_cols: list[str]) -> DataFrame:
    """Every query with its context; a retrieval miss (NO_EVIDENCE) stays apart from a budget failure."""
    status = F.coalesce("status", F.lit("NO_EVIDENCE"))
    message = F.when(status == "NO_EVIDENCE", X.NO_EVIDENCE).when(status == "BUDGET_EXCEEDED", X.BUDGET_EXCEEDED)
    joined = queries.join(contexts, query_cols, "left")
    return joined.withColumn("message", message).withColumn("status", status)


def local_citation(document: Column, name: Column, ordinal: Column, text: Column, score: Column) -> Column:
    return F.struct(
        F.lit("LOCAL_DOCUMENT").alias("kind"),
        F.concat(name, F.lit(" · chunk "), (ordinal + 1).cast("string")).alias("title"),
        F.lit(None).cast("string").alias("uri"), text.alias("excerpt"), F.lit("Local document").alias("provider"),
        score.alias("score"), source_id(document, ordinal).alias("source_id"),
    )


def web_citation(title: Column, url: Column, excerpt: Column, provider: Column, source: Column) -> Column:
    """A blank source id falls back to the URL."""
    return F.struct(
        F.lit("WEB").alias("kind"), title.alias("title"), url.alias("uri"), excerpt.alias("excerpt"),
        provider.alias("provider"), F.lit(None).cast("float").alias("score"),
        F.when(T.is_blank(F.coalesce(source, F.lit(""))), url).otherwise(source).alias("source_id"),
    )


def web_context(items: Column) -> Column:
    """Render ordered ``array<struct<source_id,title,url,content>>``; a blank id becomes ``web:<n>``."""
    def render(e: Column, i: Column) -> Column:
        sid = F.when(T.is_blank(F.coalesce(e["source_id"], F.lit(""))), F.concat(F.lit("web:"), (i + 1).cast("string"))).otherwise(e["source_id"])
        return F.concat(
            F.lit("["), sid, F.lit("] "), e["title"], F.lit("\nURL: "), e["url"],
            F.lit(f"\n{X.UNTRUSTED_MARKER}\n"), e["content"],
        )

    return F.array_join(F.transform(items, render), "\n\n")


def route(use_rag: Column, allow_web: Column, status: Column, web_hits: Column, web_error: Column | None = None) -> Column:
    """``struct<route,web_called,failure>`` of the evidence decision table.

    Only a retrieval miss may consult the web; a budget failure never does.
    """
    error = web_error if web_error is not None else F.lit(None).cast("string")
    miss = status == "NO_EVIDENCE"
    wants_web = F.when(use_rag, miss & allow_web).otherwise(allow_web)

    def out(name: str, called: Column, failure: Column) -> Column:
        return F.struct(F.lit(name).alias("route"), called.alias("web_called"), failure.cast("string").alias("failure"))

    no, yes, none = F.lit(False), F.lit(True), F.lit(None)
    empty = F.when(use_rag, X.NO_WEB_AFTER_MISS).otherwise(X.NO_WEB)
    return (
        F.when(use_rag & (status == "OK"), out("LOCAL", no, none))
        .when(use_rag & ~miss, out("FAILED", no, F.lit(X.CONTEXT_FAILED_PREFIX + X.BUDGET_EXCEEDED)))
        .when(use_rag & ~allow_web, out("WITHHELD", no, F.lit(X.WITHHELD)))
        .when(wants_web & error.isNotNull(), out("FAILED", yes, error))
        .when(wants_web & (web_hits > 0), out("WEB", yes, none))
        .when(wants_web, out("FAILED", yes, empty))
        .otherwise(out("NO_CONTEXT", no, none))
    )


def referenced_ids(answer: Column) -> Column:
    """Distinct citation markers in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(X.CITATION_PATTERN), F.lit(1)))


def bind_citations(answer: Column, citations: Column) -> Column:
    """``struct<status,message,kept>`` for an answer and its ``array<struct<source_id,...>>``.

    PASS without citations; otherwise NO_STABLE_IDS, NO_CITATION, UNKNOWN_CITATION or BOUND, keeping
    the referenced citations in their original order.
    """
    refs = referenced_ids(answer)
    usable = F.filter(citations, lambda c: ~T.is_blank(F.coalesce(c["source_id"], F.lit(""))))
    ids = F.transform(usable, lambda c: c["source_id"])
    status = (
        F.when(F.size(citations) == 0, "PASS").when(F.size(usable) == 0, "NO_STABLE_IDS")
        .when(F.size(refs) == 0, "NO_CITATION")
        .when(F.size(F.array_except(refs, ids)) > 0, "UNKNOWN_CITATION").otherwise("BOUND")
    )
    message = (
        F.when(status == "NO_STABLE_IDS", X.NO_STABLE_IDS).when(status == "NO_CITATION", X.NO_CITATION)
        .when(status == "UNKNOWN_CITATION", X.UNKNOWN_CITATION)
    )
    kept = F.when(status == "BOUND", F.filter(usable, lambda c: F.array_contains(refs, c["source_id"]))).otherwise(
        F.slice(citations, 1, 0)
    )
    return F.struct(status.alias("status"), message.alias("message"), kept.alias("kept"))


def terminal_failures(events: DataFrame, request_cols: list[str], type_col: str = "type") -> DataFrame:
    """One synthetic failure per request whose events end without Completed or Failed."""
    ended = F.coalesce(F.bool_or(F.col(type_col).isin("Completed", "Failed")), F.lit(False))
    return (
        events.groupBy(*request_cols).agg(ended.alias("_ended"), F.max("seq").alias("_last"))
        .where(~F.col("_ended"))
        .select(*request_cols, (F.col("_last") + 1).alias("seq"), F.lit("Failed").alias(type_col),
                F.lit(X.ENDED_EARLY).alias("value"))
    )


def _joined(item: Column) -> Column:
    """The ``value`` fields of a group's structs, in the structs' order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda t: t["value"]), "")


def fold_answers(events: DataFrame, request_cols: list[str]) -> DataFrame:
    """Final assistant message per request from ordered Token / Completed / Failed events.

    Tokens are appended in order; the last Completed text replaces the draft; a failure with nothing
    completed after it removes the message.  Tokens become text per range of ``PART_EVENTS`` numbers
    first, so a request's tokens are never gathered, only its parts.
    """
    done = F.col("type") == "Completed"
    end = F.max(F.when(done | (F.col("type") == "Failed"), F.struct("seq", "type", "value")))
    token = F.col("type") == "Token"
    parts = events.groupBy(*request_cols, F.floor(F.col("seq") / PART_EVENTS).alias("_part")).agg(
        end.alias("_end"), _joined(F.when(token, F.struct("seq", "value"))).alias("value"), F.count(F.when(token, 1)).alias("_n"),
    )
    ordered = parts.groupBy(*request_cols).agg(
        F.max("_end").alias("_end"), _joined(F.struct("_part", "value")).alias("draft"), F.sum("_n").alias("n_tokens")
    )
    state = F.when(F.col("_end.type") == "Completed", "COMPLETED").when(F.col("_end.type") == "Failed", "REMOVED").otherwise("DRAFT")
    text = F.when(state == "COMPLETED", F.col("_end.value")).when(state == "DRAFT", F.col("draft"))
    return ordered.select(*request_cols, state.alias("state"), text.alias("text"), "n_tokens")


def send_guard(text: Column, has_persona: Column, streaming: Column) -> Column:
    """IGNORE / ERROR / SEND for a submitted message, first rule first."""
    return (
        F.when(T.is_blank(text), "IGNORE_BLANK").when(~has_persona, "ERROR_NO_PERSONA")
        .when(streaming, "IGNORE_BUSY").otherwise("SEND")
    )
