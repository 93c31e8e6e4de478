"""Question answering up to the model boundary: embed, search, hydrate, build contexts, route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.operators import evidence as E
from ragspark.operators import search as S
from ragspark.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_text
from ragspark.operators.embedding import Embedder, with_embedding


def embed_chunks(docs: DataFrame, embedder: Embedder, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of ``docs(document_id, text)`` with their vectors."""
    return with_embedding(chunk_text(docs, "document_id", "text", size, overlap), embedder)


def retrieve(
    docs: DataFrame, questions: DataFrame, embedder: Embedder, k: int = X.SEARCH_K,
    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, chunks: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` chunks with text per question.

    ``docs(document_id, document_name, text)``; ``questions(question_id, question)``.  ``chunks`` is the
    stored chunk table when there is one.  Otherwise vectors come from one pass that never carries text
    past the scoring task, and only the documents that were hit are cut again to read the text.
    """
    asked = with_embedding(questions.select("question_id", "question"), embedder, "question", "query_vector")
    asked = asked.where(F.col("query_vector").isNotNull())
    vectors = embed_chunks(docs, embedder, size, overlap) if chunks is None else chunks
    hits = S.search_batch(vectors, asked, ["document_id", "ordinal"], ["question_id"], embedder.dimensions, k)
    if chunks is None:
        wanted = hits.select("document_id").distinct()
        chunks = chunk_text(docs.join(wanted, "document_id", "left_semi"), "document_id", "text", size, overlap)
    return S.hydrate(hits, chunks, docs)


def answer_contexts(
    docs: DataFrame, questions: DataFrame, embedder: Embedder, k: int = X.SEARCH_K, minimum: float = X.MIN_SCORE,
    limit: int = X.CONTEXT_LIMIT, max_chars: int = X.CONTEXT_CHARS, **windows: int,
) -> DataFrame:
    """Every question with its context, evidence ids and status (OK, NO_EVIDENCE, BUDGET_EXCEEDED)."""
    hits = retrieve(docs, questions, embedder, k, **windows)
    contexts = E.build_context(hits, ["question_id"], minimum, limit, max_chars)
    return E.with_status(questions.select("question_id", "question"), contexts, ["question_id"])


def route_questions(contexts: DataFrame, web: DataFrame, requests: DataFrame) -> DataFrame:
    """Evidence route per question.

    ``contexts`` from ``answer_contexts``; ``web(question_id, source_id, title, url, content, position)``
    holds at most a few rows per question; ``requests(question_id, use_rag, allow_web)``.
    """
    item = F.struct("position", "source_id", "title", "url", "content")
    found = web.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("_web"))
    joined = requests.join(contexts.select("question_id", "context", "status"), "question_id", "left").join(found, "question_id", "left")
    none = F.coalesce(F.size("_web"), F.lit(0))
    decided = joined.withColumn("_route", E.route(
        F.col("use_rag"), F.col("allow_web"), F.coalesce("status", F.lit("NO_EVIDENCE")), F.when(none > 0, none).otherwise(0)
    ))
    route = F.col("_route.route")
    return decided.select(
        "question_id", "use_rag", "allow_web", route.alias("route"), F.col("_route.web_called").alias("web_called"),
        F.col("_route.failure").alias("failure"),
        F.when(route == "LOCAL", F.col("context")).when(route == "WEB", E.web_context(F.col("_web"))).alias("context"),
    )
