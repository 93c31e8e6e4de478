"""Sampled token offsets: where every 512th token of a document begins, so that a missing chunk is cut from its own stretch.

The index is a table ``(id, block, at, n_bytes, n_tokens, text_key)`` with one row per ``every`` tokens: the block
starts at byte ``at`` of the UTF-8 text, and blocks follow each other without gaps, the space before a token
belonging to its block.  ``text_key`` is a hash of the whole text, so an index is never used on a text that
has changed since.  It is about a hundredth of the text.  With it the expected chunks of a document are
known without reading its text, and a hole reads the two or three blocks it touches.

Null and empty texts and texts of white space have no tokens, so no rows and no chunks.  Repeated ids are
not allowed, as in all stored tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, check_window, chunk_count

INDEX_TOKENS = 512


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def token_offsets(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", every: int = INDEX_TOKENS,
                  max_token_length: int = T.MAX_TOKEN_LENGTH) -> DataFrame:
    """The index of every document, in one pass of one pattern over its text."""
    if every <= 0:
        raise ValueError("every must be positive")
    one = f"[{T.WHITESPACE_CLASS}]*+{T.token_pattern(max_token_length)}+"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?:{one}){{1,{every}}}+"), F.lit(0))
    # only the last block can be short, so only its tokens are counted
    found = docs.select(F.col(id_col), pieces.alias("_f"), text_key(text_col).alias("text_key")).select(
        id_col, "text_key", F.transform("_f", lambda p: F.octet_length(p).cast("bigint")).alias("_sizes"),
        T.token_count(F.try_element_at("_f", F.lit(-1)), max_token_length).alias("_rest"), F.size("_f").alias("_n"),
    )
    # conditions sit inside explode: a filter would be pushed down and run the pattern twice
    each = F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = found.select(id_col, "text_key", "_rest", "_n", "_sizes", each.alias("block")).select(
        id_col, "text_key", "_rest", "_n", "block", F.get("_sizes", "block").alias("n_bytes"))
    before = Window.partitionBy(id_col).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        id_col, "block", F.coalesce(F.sum("n_bytes").over(before), F.lit(0).cast("bigint")).alias("at"), "n_bytes",
        F.when(F.col("block") == F.col("_n") - 1, F.col("_rest")).otherwise(every).cast("int").alias("n_tokens"), "text_key",
    )


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def indexed(docs: DataFrame, index: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` of the documents whose text is the one the index was made of."""
    heads = index.where("block = 0").select(id_col, "text_key")
    return docs.select(id_col, text_col, text_key(text_col).alias("text_key")).join(heads, [id_col, "text_key"], "left_semi").drop("text_key")


def expected_chunks(index: DataFrame, id_col: str = "document_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(id, ordinal, start_token, end_token)`` of all chunks, from the index alone."""
    check_window(size, overlap)
    totals = index.groupBy(id_col).agg(F.sum("n_tokens").cast("int").alias("_n"))
    each = F.explode(F.sequence(F.lit(0), chunk_count(F.col("_n"), size, overlap) - 1))
    start = F.col("ordinal") * (size - overlap)
    return totals.select(id_col, "_n", each.alias("ordinal")).select(
        id_col, "ordinal", start.alias("start_token"), F.least(start + size, F.col("_n")).alias("end_token"))


def stretches(wanted: DataFrame, index: DataFrame, id_col: str = "document_id", every: int = INDEX_TOKENS) -> DataFrame:
    """``wanted`` chunks with the bytes to read: ``(from_byte, n_bytes, skip)``, ``skip`` tokens coming first.

    A chunk meets only the blocks it touches, through an equi-join on (document, block).
    """
    first, last = _div(F.col("start_token"), every), _div(F.col("end_token") - 1, every)
    touched = wanted.select(id_col, "ordinal", "start_token", "end_token", F.explode(F.sequence(first, last)).alias("block"))
    found = touched.join(index.select(id_col, "block", "at", "n_bytes"), [id_col, "block"])
    return found.groupBy(id_col, "ordinal", "start_token", "end_token").agg(
        F.min("at").alias("from_byte"), F.sum("n_bytes").alias("n_bytes")
    ).withColumn("skip", F.pmod(F.col("start_token"), F.lit(every)))


def cut(docs: DataFrame, places: DataFrame, id_col: str = "document_id", text_col: str = "text",
        max_token_length: int = T.MAX_TOKEN_LENGTH) -> DataFrame:
    """``(id, ordinal, text, start_token, end_token)`` of the chunks at ``places`` (from ``stretches``).

    The places of a document travel to its text, not the text to each of them; bytes are sliced, so
    a place deep in a long text costs no walk over what precedes it.
    """
    of_one = places.groupBy(id_col).agg(
        F.collect_list(F.struct("ordinal", "start_token", "end_token", "from_byte", "n_bytes", "skip")).alias("_places"))
    data = F.col(text_col).cast("binary")
    sliced = docs.select(F.col(id_col), data.alias("_data")).join(of_one, id_col).select(id_col, F.explode(F.transform("_places", lambda p: F.struct(
        p["ordinal"].alias("ordinal"), p["start_token"].alias("start_token"), p["end_token"].alias("end_token"), p["skip"].alias("skip"),
        F.substring(F.col("_data"), (p["from_byte"] + 1).cast("int"), p["n_bytes"].cast("int")).cast("string").alias("stretch"),
    ))).alias("p")).select(id_col, "p.*")
    words = F.slice(T.tokens(F.col("stretch"), max_token_length), F.col("skip") + 1, F.col("end_token") - F.col("start_token"))
    return sliced.select(id_col, "ordinal", F.array_join(words, " ").alias("text"), "start_token", "end_token")


def fill_holes(docs: DataFrame, index: DataFrame, complete: DataFrame, id_col: str = "document_id", text_col: str = "text",
               size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, every: int = INDEX_TOKENS,
               max_token_length: int = T.MAX_TOKEN_LENGTH) -> DataFrame:
    """The chunks of indexed documents that ``complete`` (id, ordinal) lacks, each cut from its own stretch.

    Documents whose text is not the one indexed (see ``indexed``) give no rows: they must be cut and indexed anew.
    """
    docs = indexed(docs, index, id_col, text_col)
    wanted = expected_chunks(index, id_col, size, overlap).join(complete.select(id_col, "ordinal"), [id_col, "ordinal"], "left_anti")
    return cut(docs, stretches(wanted, index, id_col, every), id_col, text_col, max_token_length)
