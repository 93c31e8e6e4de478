"""Incremental ingestion as one lazy job per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import vectors as V
from ragspark.operators import catalog as C
from ragspark.operators import offsets as O
from ragspark.operators.chunking import chunk_text
from ragspark.operators.embedding import Embedder, with_embedding
from ragspark.sources.store import BucketStore


NO_TEXT = "No text was extracted"


@dataclass(frozen=True)
class Ingested:
    """New tables and the per-file outcome of one ingestion."""

    chunks: DataFrame
    catalog: DataFrame
    outcomes: DataFrame


def ingest(
    listing: DataFrame, texts: DataFrame, catalog: DataFrame, chunks: DataFrame, embedder: Embedder,
) -> Ingested:
    """Index what is new, changed or incomplete; leave the rest untouched.

    ``listing`` has the catalog's metadata columns, ``texts(document_id, text, error)`` the extracted
    text; a document to index that has no text row, or neither text nor error, is FAILED with a reason.
    Keys are deterministic, so running again after a failure gives the same tables.  An
    incomplete document is completed by embedding only the chunks it lacks.
    """
    complete = V.is_valid(F.col("embedding"), embedder.dimensions)
    healthy = C.health(catalog, chunks, complete).where("healthy").select("document_id")
    state = C.classify(listing, catalog, healthy)
    changed = state.where("status = 'CHANGED'").select("document_id")
    kept = C.delete_documents(chunks, changed).where(complete)
    wanted = chunk_text(_open_texts(texts, state), "document_id", "text")
    new_chunks = _completed(kept, wanted, embedder)
    outcomes = _outcomes(state, texts)
    return Ingested(new_chunks, _headers(listing, catalog, outcomes, new_chunks), outcomes)


def ingest_store(store: BucketStore, listing: DataFrame, texts: DataFrame, embedder: Embedder, audit: bool = False) -> DataFrame:
    """The same on a stored corpus: only buckets that hold a document to index are read and written.

    ``store`` has the tables ``catalog``, ``chunks`` and ``offsets``.  Which documents are open follows from the
    listing and the headers; with ``audit``, documents with an incomplete chunk are found too, which reads the
    ordinals and vectors of all chunks, but no text.  A document whose text is the one indexed has its missing chunks
    cut by the offset index; any other loses its chunks and is cut whole.  The new buckets of all tables become
    visible at once; a run that dies before leaves the store as it was, and running again gives the same tables.

    Returns the outcome of every listed or stored document, ``(document_id, status, outcome, reason)``.
    """
    complete = V.is_valid(F.col("embedding"), embedder.dimensions)
    catalog = store.read("catalog")
    healthy = C.health(catalog, store.read("chunks"), complete).where("healthy").select("document_id") if audit else None
    run = store.begin()
    state = run.keep("state", C.classify(listing, catalog, healthy))
    touched = store.buckets_of(state.where(F.col("status").isin(*_OPEN)))
    if not touched:
        return _outcomes(state, texts)
    inside = store.bucket().isin(touched)
    texts, stored = texts.where(inside), {name: store.read(name, touched) for name in ("catalog", "chunks", "offsets")}
    here = state.where(inside)

    open_texts = _open_texts(texts, here)
    same = O.indexed(open_texts, stored["offsets"])
    recut = run.keep("recut", open_texts.join(same.select("document_id"), "document_id", "left_anti"))
    # a changed document is embedded anew even if its text is the old one: its listing says so
    stale = here.where("status = 'CHANGED'").select("document_id").unionByName(recut.select("document_id"))
    kept = C.delete_documents(stored["chunks"], stale).where(complete)
    by_index = stored["offsets"].join(same.select("document_id"), "document_id", "left_semi")
    wanted = chunk_text(recut, "document_id", "text").unionByName(O.fill_holes(same, by_index, kept))

    new_chunks = run.stage("chunks", _completed(kept, wanted, embedder))
    run.stage("offsets", C.delete_documents(stored["offsets"], recut).unionByName(O.token_offsets(recut)))
    outcomes = _outcomes(here, texts)
    run.stage("catalog", _headers(listing.where(inside), stored["catalog"], outcomes, new_chunks))
    run.publish(touched)
    return _outcomes(state.where(~inside), texts.limit(0)).unionByName(outcomes)


_OPEN = ("NEW", "CHANGED", "INCOMPLETE")


def _open_texts(texts: DataFrame, state: DataFrame) -> DataFrame:
    usable = texts.where(F.col("error").isNull() & F.col("text").isNotNull()).select("document_id", "text")
    return usable.join(state.where(F.col("status").isin(*_OPEN)).select("document_id"), "document_id", "left_semi")


def _completed(kept: DataFrame, wanted: DataFrame, embedder: Embedder) -> DataFrame:
    """``kept`` chunks and, embedded, the wanted ones that are not among them."""
    fresh = with_embedding(wanted.join(kept.select("document_id", "ordinal"), ["document_id", "ordinal"], "left_anti"), embedder)
    return kept.unionByName(fresh.select(*kept.columns))


def _outcomes(state: DataFrame, texts: DataFrame) -> DataFrame:
    # without text there is nothing to index, so the document must not count as done
    missing = F.when(F.col("text_found").isNull(), NO_TEXT)
    extracted = texts.select("document_id", "error", F.when(F.col("text").isNotNull(), True).alias("text_found"))
    return state.join(extracted, "document_id", "left").withColumn("error", F.coalesce("error", missing)).select(
        "document_id", "status",
        F.when(F.col("status") == "UNCHANGED", "SKIPPED").when(F.col("status") == "REJECTED", "FAILED")
        .when(F.col("status") == "ABSENT", "ABSENT").when(F.col("error").isNotNull(), "FAILED").otherwise("INDEXED").alias("outcome"),
        F.when(F.col("status") == "REJECTED", F.col("reason")).when(
            ~F.col("status").isin("UNCHANGED", "ABSENT"), F.coalesce("reason", "error")).otherwise(F.col("reason")).alias("reason"),
    )


def _headers(listing: DataFrame, catalog: DataFrame, outcomes: DataFrame, new_chunks: DataFrame) -> DataFrame:
    counts = new_chunks.groupBy("document_id").agg((F.max("ordinal") + 1).alias("_n"))
    touched = listing.join(outcomes.where(F.col("outcome").isin("INDEXED", "FAILED") & (F.col("status") != "REJECTED")), "document_id").join(
        counts, "document_id", "left"
    ).select(
        *listing.columns, F.coalesce("_n", F.lit(0)).cast("int").alias("chunk_count"), (F.col("outcome") == "INDEXED").alias("indexed")
    )
    return C.delete_documents(catalog, touched).unionByName(touched.select(*catalog.columns))
