"""Token windows.

A document becomes rows of pieces before it becomes tokens: texts up to ``PIECE_CHARS`` are one
piece, longer ones are cut every ``PIECE_CHUNKS`` chunk starts.  Each piece is tokenised together
with the head of the next, so the token array in memory is bounded however long the document is,
and the windows are the same as those over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as T

CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
WINDOW_LENGTH = 256
PIECE_CHARS = 1_000_000
PIECE_CHUNKS = 256


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")


def chunk_count(n_tokens: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of chunks of a document with ``n_tokens`` tokens; none for an empty document."""
    check_window(size, overlap)
    step = size - overlap
    more = F.call_function("div", n_tokens - F.lit(size) + F.lit(step - 1), F.lit(step)) + 1
    return F.when(n_tokens <= 0, 0).when(n_tokens <= size, 1).otherwise(more).cast("int")


def chunk_text(
    docs: DataFrame,
    id_col: str = "document_id",
    text_col: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    max_token_length: int = T.MAX_TOKEN_LENGTH,
    piece_chars: int = PIECE_CHARS,
    piece_chunks: int = PIECE_CHUNKS,
) -> DataFrame:
    """``(id, ordinal, text, start_token, end_token)`` for every overlapping window of every document.

    The last window may be short, an empty document has none, and no window consists of overlap only.
    """
    check_window(size, overlap)
    step = size - overlap
    piece_chunks = max(piece_chunks, -(-size // step))  # the next piece must hold a whole head
    piece_tokens = piece_chunks * step
    one = f"[{T.WHITESPACE_CLASS}]*+{T.token_pattern(max_token_length)}+"

    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a, F.lit(b)).cast("int")

    pieces = docs.select(
        F.col(id_col),
        F.when(F.length(text_col) <= piece_chars, F.array(text_col)).otherwise(
            F.regexp_extract_all(F.col(text_col), F.lit(f"(?:{one}){{1,{piece_tokens}}}+"), F.lit(0))
        ).alias("_pieces"),
    )
    # conditions sit inside explode: a filter would be pushed down and run the pattern twice
    each = F.when(F.size("_pieces") > 0, F.sequence(F.lit(0), F.size("_pieces") - 1))
    rows = pieces.select(id_col, "_pieces", F.explode(each).alias("_p")).select(
        id_col, "_p",
        F.get("_pieces", "_p").alias("_body"),
        F.regexp_extract(F.get("_pieces", F.col("_p") + 1), f"^(?:{one}){{1,{size}}}+", 0).alias("_next"),
    )
    tokenised = rows.select(
        id_col, "_p", T.tokens(F.col("_body"), max_token_length).alias("_body_tokens"),
        F.coalesce(T.tokens(F.col("_next"), max_token_length), F.array().cast("array<string>")).alias("_head"),
    ).select(
        id_col, "_p", F.size("_body_tokens").alias("_nb"),
        F.concat("_body_tokens", "_head").alias("_t"),
    )
    # a window starts inside the piece, and (but for the first) has more than the overlap left
    in_body = div(F.col("_nb") + step - 1, step)
    has_rest = F.greatest(div(F.size("_t") - 1 - overlap + step, step), F.when(F.col("_p") == 0, 1).otherwise(0))
    count = F.least(in_body, has_rest)
    exploded = tokenised.select(
        id_col, "_p", "_t", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("_i")
    )
    local = F.col("_i") * step
    return exploded.select(
        id_col,
        (F.col("_p") * piece_chunks + F.col("_i")).alias("ordinal"),
        F.array_join(F.slice("_t", local + 1, F.lit(size)), " ").alias("text"),
        (F.col("_p") * piece_tokens + local).alias("start_token"),
        (F.col("_p") * piece_tokens + F.least(local + size, F.size("_t"))).alias("end_token"),
    )


def rebase(chunks: DataFrame, ordinals: int, overlap: int = CHUNK_OVERLAP, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of a resumed source renumbered to follow ``ordinals`` finished ones."""
    tokens = ordinals * (size - overlap)
    shift = {"ordinal": ordinals, "start_token": tokens, "end_token": tokens}
    return chunks.select(*[(F.col(c) + shift[c]).alias(c) if c in shift else F.col(c) for c in chunks.columns])


def coverage_audit(chunks: DataFrame, id_col: str, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Per document: chunk count, covered tokens, contiguous ordinals and exact overlaps.

    A chunk meets the next one through a self equi-join on ``ordinal + 1``, so one huge document is
    spread over many tasks.
    """
    cur = chunks.select(id_col, "ordinal", "start_token", "end_token")
    nxt = chunks.select(
        F.col(id_col), (F.col("ordinal") - 1).alias("ordinal"), F.col("start_token").alias("_next_start")
    )
    joined = cur.join(nxt, [id_col, "ordinal"], "left")
    gap_ok = F.col("_next_start").isNull() | (F.col("end_token") - F.col("_next_start") == overlap)
    return joined.groupBy(id_col).agg(
        F.count("*").alias("n_chunks"),
        F.max("end_token").cast("bigint").alias("n_tokens"),
        (F.max("ordinal") + 1 == F.count("*")).alias("contiguous"),
        F.bool_and(gap_ok).alias("overlap_ok"),
    )


def replay_status(n_tokens: Column, resume_start: Column, next_ordinal: Column, overlap: int = CHUNK_OVERLAP) -> Column:
    """Outcome of replaying the overlap: CHANGED, COMPLETE or CONTINUE.

    A document that ended inside its first overlap is complete, not changed.
    """
    left = n_tokens - resume_start
    short_complete = (resume_start == 0) & (n_tokens > 0) & (n_tokens <= overlap)
    return (
        F.when(left < 0, "CHANGED")
        .when(next_ordinal == 0, "CONTINUE")
        .when(short_complete, "COMPLETE")
        .when(left < overlap, "CHANGED")
        .when(left == overlap, "COMPLETE")
        .otherwise("CONTINUE")
    )


def _payload(max_length: int) -> int:
    if max_length < 3:
        raise ValueError("max_length must allow special tokens")
    return max_length - 2


def _last_window(ids: Column, payload: int) -> Column:
    return F.greatest(F.lit(0), F.call_function("div", F.size(ids) - 1, F.lit(payload)).cast("int"))


def _framed(ids: Column, i: Column, cls_id: int, sep_id: int, pad_id: int, max_length: int) -> list[Column]:
    payload = _payload(max_length)

    def long(v: int) -> Column:
        return F.lit(v).cast("bigint")

    part = F.slice(ids, i * payload + 1, F.lit(payload)).cast("array<bigint>")
    length = F.least(F.size(ids) - i * payload, F.lit(payload))
    pad = F.lit(payload) - length
    return [
        F.concat(F.array(long(cls_id)), part, F.array(long(sep_id)), F.array_repeat(long(pad_id), pad)).alias("input_ids"),
        F.concat(F.array_repeat(long(1), length + 2), F.array_repeat(long(0), pad)).alias("attention_mask"),
        F.array_repeat(long(0), max_length).alias("token_type_ids"),
    ]


def id_windows(ids: Column, cls_id: int, sep_id: int, pad_id: int = 0, max_length: int = WINDOW_LENGTH) -> Column:
    """Disjoint framed windows of token ids; an empty input still yields one window.

    ``array<struct<input_ids, attention_mask, token_type_ids>>``, each of ``max_length`` longs.
    """
    each = F.sequence(F.lit(0), _last_window(ids, _payload(max_length)))
    return F.transform(each, lambda i: F.struct(*_framed(ids, i, cls_id, sep_id, pad_id, max_length)))


def window_rows(df: DataFrame, ids_col: str, cls_id: int, sep_id: int, pad_id: int = 0, max_length: int = WINDOW_LENGTH) -> DataFrame:
    """The same windows as rows ``(..., window_no, input_ids, attention_mask, token_type_ids)``.

    Windows are built one at a time after the explode, never as an array of all of them.
    """
    ids = F.col(ids_col)
    each = F.sequence(F.lit(0), _last_window(ids, _payload(max_length)))
    kept = [c for c in df.columns if c != ids_col]
    numbered = df.select(*kept, ids_col, F.explode(each).alias("window_no"))
    return numbered.select(*kept, "window_no", *_framed(ids, F.col("window_no"), cls_id, sep_id, pad_id, max_length))


def single_window(windows: Column) -> Column:
    """The only window; raises when the text needs more than one (never truncates)."""
    return F.when(F.size(windows) == 1, windows[0]).otherwise(
        F.raise_error(F.lit("Input exceeds one window; use id_windows for long text"))
    )


def common_prefix(left: Column, right: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda a, b: a.eqNullSafe(b))
    miss = F.array_position(pairs, False)
    return F.when(miss == 0, n.cast("bigint")).otherwise(miss - 1)


def reusable_prefix(common: Column, n_tokens: Column) -> Column:
    """Position decoding restarts from: the last prompt token is decoded again on a full match."""
    return F.when((common > 0) & (n_tokens <= common), common - 1).otherwise(common)


def first_and_last(chunks: DataFrame, id_col: str, complete: Column) -> DataFrame:
    """First incomplete, last complete and last ordinal per document, from one partial aggregation."""
    return chunks.groupBy(id_col).agg(
        F.min(F.when(~complete, F.col("ordinal"))).alias("first_incomplete"),
        F.max(F.when(complete, F.col("ordinal"))).alias("last_complete"),
        F.max("ordinal").alias("last_ordinal"),
    )


