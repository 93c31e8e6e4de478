"""Embedding boundary and vector pooling.

No model ships with the library.  ``HashedBagOfWords`` is a deterministic stand-in so that the data
operators around a model can run; replace it with any object that has the same two members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.functions import vectors as V
from ragspark.operators.chunking import WINDOW_LENGTH, window_rows


class BoundaryUnavailable(RuntimeError):
    """An external model is not installed.  Boundaries fail; they never invent output."""


class Embedder(Protocol):
    """Non-blank text to ``dimensions`` finite, L2-normalised floats."""

    dimensions: int

    def embed(self, text: Column) -> Column: ...


class Unavailable:
    """Fail-closed default for every model boundary (embedding, generation, speech, translation)."""

    dimensions = 0

    def __init__(self, what: str = "model"):
        self.what = what

    def _fail(self, *_: object) -> Column:
        raise BoundaryUnavailable(f"{self.what} is not available")

    embed = generate = transcribe = translate = recognise = speak = _fail


class HashedBagOfWords:
    """Stand-in embedder: pretokens counted in MD5 buckets, then L2-normalised.

    The bucket of a token is the number in its first eight hex digits modulo ``dimensions``.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        dim = self.dimensions

        @F.arrow_udf("array<float>")
        def hashed(tokens: pa.Array) -> pa.Array:
            return pa.concat_arrays([_hash_counts(part, dim) for part in token_blocks(tokens)])

        return hashed(T.pretokens(text))


BLOCK_TOKENS = 1 << 19


def token_blocks(tokens: pa.ListArray, block_tokens: int = BLOCK_TOKENS) -> Iterator[pa.ListArray]:
    """Stretches of rows with at most ``block_tokens`` tokens in all, or one row; at least one stretch.

    What is made of a batch besides its result then follows the block, not the rows that Spark put into the batch.
    """
    ends = tokens.offsets.to_numpy()
    low = 0
    while True:
        high = max(low + 1, int(np.searchsorted(ends, int(ends[low]) + block_tokens, "right")) - 1)
        yield tokens.slice(low, high - low)
        if high >= len(tokens):
            return
        low = high


def _hash_counts(tokens: pa.Array, dim: int) -> pa.Array:
    n = len(tokens)
    parents = pc.list_parent_indices(tokens).to_numpy()
    encoded = pc.list_flatten(tokens).dictionary_encode()
    words = encoded.dictionary.to_pylist()
    bucket = np.fromiter((int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words), np.int64, len(words))
    cells = parents * dim + (bucket[encoded.indices.to_numpy()] if words else np.empty(0, np.int64))
    return _unit_counts(cells, n, dim)


def _unit_counts(cells: np.ndarray, n: int, dim: int) -> pa.Array:
    """Unit vectors of the counts of ``row * dim + bucket``; null for a row without any."""
    counts = np.bincount(cells, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(axis=1))
    unit = (counts / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32)
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    blank = pa.array(norm == 0)
    lists = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
    return pc.if_else(blank, pa.scalar(None, lists.type), lists)


class WindowModel(Protocol):
    """One framed window of token ids to ``dimensions`` finite, L2-normalised floats."""

    dimensions: int

    def embed(self, input_ids: Column, attention_mask: Column) -> Column: ...


class HashedIds:
    """Stand-in window model: the active ids counted modulo ``dimensions``, then L2-normalised."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, input_ids: Column, attention_mask: Column) -> Column:
        dim = self.dimensions

        @F.arrow_udf("array<float>")
        def hashed(ids: pa.Array, mask: pa.Array) -> pa.Array:
            active = pc.list_flatten(mask).to_numpy() == 1
            cells = pc.list_parent_indices(ids).to_numpy() * dim + pc.list_flatten(ids).to_numpy() % dim
            return _unit_counts(cells[active], len(ids), dim)

        return hashed(input_ids, attention_mask)


def embed_windows(
    texts: DataFrame, keys: list[str], ids_col: str, model: WindowModel, cls_id: int, sep_id: int, pad_id: int = 0,
    max_length: int = WINDOW_LENGTH,
) -> DataFrame:
    """``keys, embedding``: token ids to framed windows, a vector each, averaged by their active tokens.

    The windows of a text are made in the task that holds it, so the mean combines before its shuffle.
    """
    rows = window_rows(texts.select(*keys, ids_col), ids_col, cls_id, sep_id, pad_id, max_length)
    mask = F.col("attention_mask")
    vectors = rows.select(*keys, model.embed(F.col("input_ids"), mask).alias("embedding"), V.active_tokens(mask).alias("weight"))
    return weighted_mean(vectors, keys, model.dimensions)


def with_embedding(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Add the vector of each text; blank text has none."""
    return df.withColumn(out, embedder.embed(F.col(text_col)))


def weighted_mean(
    windows: DataFrame, keys: list[str], dimensions: int, vector_col: str = "embedding", weight_col: str = "weight",
    normalise: bool = True,
) -> DataFrame:
    """Weighted mean of window vectors per key, L2-normalised; null when the norm is unusable.

    One sum per dimension, so the aggregation combines on the map side and moves one row per key and
    task instead of one row per vector.  A window with a wrong dimension, a non-finite value or a
    weight that is not positive fails the job.
    """
    ok = V.is_valid(F.col(vector_col), dimensions) & (F.col(weight_col) > 0)
    checked = windows.select(
        *keys, F.col(weight_col).cast("double").alias("_w"),
        F.when(ok, F.col(vector_col)).otherwise(F.raise_error(F.lit("invalid window vector or weight"))).alias("_v"),
    )
    sums = [F.sum(F.col("_v")[i].cast("double") * F.col("_w")).alias(f"_s{i}") for i in range(dimensions)]
    total = checked.groupBy(*keys).agg(F.sum("_w").alias("_total"), *sums)
    mean = F.array(*[F.col(f"_s{i}") / F.col("_total") for i in range(dimensions)])
    out = total.select(*keys, mean.alias("_mean"))
    value = V.l2_normalise(F.col("_mean")) if normalise else F.transform("_mean", lambda x: x.cast("float"))
    return out.select(*keys, value.alias(vector_col))


def mean_pool(positions: Column, mask: Column, dimensions: int) -> Column:
    """Mean of the position vectors whose mask is 1; raises when sizes differ or none is active."""
    active = F.filter(F.arrays_zip(positions.alias("v"), mask.alias("m")), lambda p: p["m"] == 1)
    sums = F.aggregate(
        active, F.array_repeat(F.lit(0.0), dimensions),
        lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x.cast("double")),
    )
    return (
        F.when(F.size(positions) != F.size(mask), F.raise_error(F.lit("sequence length does not match the mask")))
        .when(F.size(active) == 0, F.raise_error(F.lit("no active tokens")))
        .otherwise(F.transform(sums, lambda s: (s / F.size(active)).cast("float")))
    )
