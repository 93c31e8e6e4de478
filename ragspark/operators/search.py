"""Exact cosine search.

One query is a literal folded into the scan.  A batch of queries is scored in Arrow blocks with
numpy: only the running top k of each task leaves it, never a (query, vector) pair.

Queries of at most ``QUERY_BYTES`` in all are broadcast and take one pass over the corpus, which is neither
shuffled nor replicated; they are scored in tiles of ``TILE_QUERIES`` queries by ``TILE_ROWS`` vectors.  More
queries and the corpus meet as rows in a grid: a task holds a block of about ``BLOCK_BYTES`` of queries, whatever
their number in all, and streams a share of the corpus.  The pairs are quadratic by nature; the corpus is sent once
for each block, the queries once for each share.  With ``pruned``, queries go instead to the pivot cells of the
corpus that they have to read (see ``cells``), which pays where vectors are clustered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import vectors as V

MAX_K = 50
DEFAULT_K = 5
QUERY_BYTES = 16 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024
TILE_QUERIES = 512
TILE_ROWS = 4096


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")


def check_vector(vector: Sequence[float], dimensions: int) -> None:
    if len(vector) != dimensions:
        raise ValueError(f"vector must have {dimensions} dimensions")
    if not np.all(np.isfinite(np.asarray(vector, dtype=np.float64))):
        raise ValueError("vector contains a non-finite value")


def search(corpus: DataFrame, vector: Sequence[float], id_cols: Sequence[str], k: int = DEFAULT_K,
           vector_col: str = "embedding") -> DataFrame:
    """Top ``k`` of one query vector: a narrow scan and TakeOrderedAndProject, no shuffle of the corpus."""
    check_k(k)
    check_vector(vector, len(vector))
    scored = corpus.where(V.is_valid(F.col(vector_col), len(vector))).select(
        *id_cols, V.cosine_to(F.col(vector_col), list(vector)).alias("score")
    )
    return scored.orderBy(F.desc("score"), *id_cols).limit(k)


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted dimension with only finite values, and the positions they came from."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == dimensions)
    flat = pc.list_flatten(column.take(pa.array(keep))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dimensions)
    finite = np.isfinite(rows).all(axis=1)
    return rows[finite], keep[finite]


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have no direction (their scores are -1)."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    bad = ~np.isfinite(norm) | (norm == 0)
    unit = rows / np.where(bad, 1.0, norm)[:, None]
    unit[bad] = 0.0
    return unit, bad


class _TopK:
    """Running top k of one tile of queries; order is score descending, ids ascending."""

    def __init__(self, query_ids: pa.Table, unit: np.ndarray, bad: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.query_ids, self.unit, self.bad, self.k = query_ids, unit, bad, k
        self.floor = np.full(len(unit), -np.inf, dtype=np.float32) if floor is None else floor
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.float32)
        self.ids: pa.Table | None = None

    def add(self, ids: pa.Table, unit: np.ndarray, bad: np.ndarray) -> None:
        """Corpus rows, at most ``TILE_ROWS``."""
        scores = (self.unit @ unit.T).astype(np.float32)
        np.clip(scores, -1.0, 1.0, out=scores)
        scores[:, bad] = -1.0
        scores[self.bad, :] = -1.0
        floor = self.floor
        if scores.shape[1] > self.k:
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            floor = np.maximum(floor, kth)
        qi, ci = np.nonzero(scores >= floor[:, None])  # ties are kept until the ids decide
        if not len(qi):
            return
        found = ids.take(pa.array(ci))
        self.query = np.concatenate([self.query, qi])
        self.score = np.concatenate([self.score, scores[qi, ci]])
        self.ids = found if self.ids is None else pa.concat_tables([self.ids, found])
        self._shrink()

    def _shrink(self) -> None:
        # the zero added to the negated score makes -0.0 and 0.0 one value
        order_by = pa.table({"q": self.query, "s": -self.score + np.float32(0)})
        for i, c in enumerate(self.ids.column_names):
            order_by = order_by.append_column(f"i{i}", self.ids.column(c))
        order = pc.sort_indices(order_by, [(c, "ascending") for c in order_by.column_names]).to_numpy()
        q = self.query[order]
        first = np.searchsorted(q, q, side="left")
        keep = order[np.arange(len(q)) - first < self.k]
        self.query, self.score = self.query[keep], self.score[keep]
        self.ids = self.ids.take(pa.array(keep)).combine_chunks()
        count = np.bincount(self.query, minlength=len(self.floor))
        last = np.cumsum(count) - 1
        full = count >= self.k
        self.floor[full] = self.score[last[full]]

    def result(self, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
        if self.ids is None:
            return
        out = self.query_ids.take(pa.array(self.query))
        for c in self.ids.column_names:
            out = out.append_column(c, self.ids.column(c))
        yield from out.append_column("score", pa.array(self.score)).select(columns).to_batches()


def _tiles(query_ids: pa.Table, matrix: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[_TopK]:
    """``floor``: scores below it are of no use to the query."""
    unit, bad = _unit(matrix)
    cuts = [slice(i, i + TILE_QUERIES) for i in range(0, len(unit), TILE_QUERIES)]
    return [_TopK(query_ids.slice(c.start, TILE_QUERIES), unit[c], bad[c], k, None if floor is None else floor[c].copy()) for c in cuts]


def _size(asked: DataFrame, query_cols: Sequence[str], dimensions: int) -> int:
    """Bytes of the queries' ids and vectors."""
    width = F.lit(dimensions * 8).cast("bigint")
    for c in query_cols:
        width = width + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return asked.agg(F.sum(width)).first()[0] or 0


def _score_grid(k: int, dimensions: int, id_cols: Sequence[str], query_cols: Sequence[str], columns: Sequence[str]):
    """Rows sorted by place in the grid, queries (``kind`` 0) before vectors: the best ``k`` of each query in each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tiles = None, []
        for batch in batches:
            place, kind = batch.column("_place").to_numpy(), batch.column("_kind").to_numpy()
            cuts = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(place)]):
                if place[i] != now:
                    for tile in tiles:
                        yield from tile.result(columns)
                    now, tiles = place[i], []
                rows = batch.slice(i, j - i)
                if kind[i] == 0:
                    matrix, where = _matrix(rows.column("_vector"), dimensions)
                    tiles += _tiles(pa.Table.from_batches([rows.select(query_cols)]).take(pa.array(where)), matrix, k)
                    continue
                for start in range(0, rows.num_rows, TILE_ROWS) if tiles else ():
                    part = rows.slice(start, TILE_ROWS)
                    matrix, where = _matrix(part.column("_vector"), dimensions)
                    if len(matrix):
                        ids = pa.Table.from_batches([part.select(id_cols)]).take(pa.array(where))
                        unit, bad = _unit(matrix)
                        for tile in tiles:
                            tile.add(ids, unit, bad)
        for tile in tiles:
            yield from tile.result(columns)

    return run


def _grid(narrow: DataFrame, asked: DataFrame, id_cols: Sequence[str], query_cols: Sequence[str], dimensions: int, k: int,
          vector_col: str, query_vector_col: str, schema: T.StructType, size: int) -> DataFrame:
    """Best ``k`` of every query in every share of the corpus; a row's ids and vector decide its block or share."""
    blocks = math.ceil(size / BLOCK_BYTES)
    shares = math.ceil(4 * narrow.sparkSession.sparkContext.defaultParallelism / blocks)

    def rows(df: DataFrame, ids: Sequence[str], other: Sequence[str], vector: str, kind: int, place: Column) -> DataFrame:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ids])
        return df.where(known & F.col(vector).isNotNull()).select(
            F.explode(place).alias("_place"), F.lit(kind).alias("_kind"), *ids, *[F.lit(None).cast(schema[c].dataType).alias(c) for c in other],
            F.col(vector).alias("_vector"))

    block = F.pmod(F.xxhash64(*query_cols, query_vector_col), F.lit(blocks)).cast("int")
    share = F.pmod(F.xxhash64(*id_cols, vector_col), F.lit(shares)).cast("int")
    met = rows(asked, query_cols, id_cols, query_vector_col, 0, F.sequence(block * shares, block * shares + (shares - 1))).unionByName(
        rows(narrow, id_cols, query_cols, vector_col, 1, F.sequence(share, share + (blocks - 1) * shares, F.lit(shares))))
    dealt = met.repartitionById(blocks * shares, F.col("_place")).sortWithinPartitions("_place", "_kind")
    return dealt.mapInArrow(_score_grid(k, dimensions, list(id_cols), list(query_cols), schema.names), schema)


def _one_pass(narrow: DataFrame, asked: DataFrame, id_cols: Sequence[str], query_cols: Sequence[str], dimensions: int, k: int,
              vector_col: str, query_vector_col: str, schema: T.StructType) -> DataFrame:
    """Best ``k`` of every query in every task of the corpus, with the queries in a broadcast."""
    columns = schema.names
    table = asked.toArrow()
    matrix, where = _matrix(table.column(query_vector_col), dimensions)
    # plain Arrow and numpy values: a broadcast is unpickled without the package
    shared = narrow.sparkSession.sparkContext.broadcast((table.select(query_cols).take(pa.array(where)), matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(*shared.value, k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                rows, where = _matrix(part.column(vector_col), dimensions)
                if len(rows):
                    ids = pa.Table.from_batches([part.select(id_cols)]).take(pa.array(where))
                    unit, bad = _unit(rows)
                    for tile in tiles:
                        tile.add(ids, unit, bad)
        for tile in tiles:
            yield from tile.result(columns)

    return narrow.mapInArrow(score, schema)


def search_batch(
    corpus: DataFrame,
    queries: DataFrame,
    id_cols: Sequence[str],
    query_cols: Sequence[str],
    dimensions: int,
    k: int = DEFAULT_K,
    vector_col: str = "embedding",
    query_vector_col: str = "query_vector",
    query_bytes: int = QUERY_BYTES,
    pruned: bool = False,
) -> DataFrame:
    """``query ids, corpus ids, score, rank`` of the exact top ``k`` for every query.

    Id columns may be numbers or strings; query and corpus id names must differ.  Rows whose vector
    is null, of another length or not finite are not searched, nor are rows with a null id.  ``pruned``: more queries
    than ``query_bytes`` go to pivot cells.
    """
    check_k(k)
    id_cols, query_cols = list(id_cols), list(query_cols)
    narrow = corpus.select(*id_cols, vector_col)
    asked = queries.select(*query_cols, query_vector_col)
    types = {f.name: f for f in [*asked.schema, *narrow.schema]}
    schema = T.StructType([types[c] for c in (*query_cols, *id_cols)] + [T.StructField("score", T.FloatType())])
    size = _size(asked, query_cols, dimensions)
    if size > query_bytes and pruned:
        from ragspark.operators.cells import build_cells, search_cells

        index = build_cells(narrow, id_cols, dimensions, vector_col)
        return search_cells(index, asked, id_cols, query_cols, dimensions, k, vector_col, query_vector_col)
    if size > query_bytes:
        partial = _grid(narrow, asked, id_cols, query_cols, dimensions, k, vector_col, query_vector_col, schema, size)
    else:
        partial = _one_pass(narrow, asked, id_cols, query_cols, dimensions, k, vector_col, query_vector_col, schema)
    # said here once, so that every use of the hits has the same exchange and the corpus is scored once
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*query_cols, *id_cols)])
    # the row limit is applied before the shuffle too
    best = Window.partitionBy(*query_cols).orderBy(F.desc("score"), *id_cols)
    return partial.where(known).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, document_col: str = "document_id",
            name_col: str = "document_name") -> DataFrame:
    """Ranked hits joined to chunk text and document name; misses drop out, ranks are kept.

    Text is read only here, after the top k is known.  Adaptive execution broadcasts the hits when
    their measured size allows it and shuffles on the chunk key otherwise.
    """
    return (
        chunks.select(document_col, "ordinal", "text")
        .join(hits, [document_col, "ordinal"])
        .join(documents.select(document_col, name_col), document_col)
        .withColumn("score", V.clamp_score(F.col("score")))
    )


def page_after(corpus: DataFrame, id_col: str, after: int, rows: int, complete=None) -> DataFrame:
    """Keyset page: ids above ``after`` in id order."""
    page = corpus.where(F.col(id_col) > after)
    return (page if complete is None else page.where(complete)).orderBy(id_col).limit(rows)


def upsert_vectors(chunks: DataFrame, updates: DataFrame, keys: Sequence[str], vector_col: str = "embedding") -> DataFrame:
    """Chunks with new vectors in place; chunks without an update keep theirs."""
    new = updates.select(*keys, F.col(vector_col).alias("_new"))
    columns = [F.coalesce("_new", vector_col).alias(c) if c == vector_col else F.col(c) for c in chunks.columns]
    return chunks.join(new, list(keys), "left").select(*columns)


def rejected_updates(chunks: DataFrame, updates: DataFrame, keys: Sequence[str], dimensions: int,
                     vector_col: str = "embedding") -> DataFrame:
    """Updates that must not be applied, with the reason: a bad vector, or no such chunk."""
    known = chunks.select(*keys).distinct().withColumn("_known", F.lit(True))
    reason = F.when(~V.is_valid(F.col(vector_col), dimensions), "INVALID_VECTOR").when(
        F.col("_known").isNull(), "UNKNOWN_CHUNK"
    )
    return updates.join(known, list(keys), "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("_known")


def orphans(vectors: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return vectors.join(chunks.select(*keys), list(keys), "left_anti")


def reconcile(vectors: DataFrame, chunks: DataFrame, keys: Sequence[str], dimensions: int,
              vector_col: str = "embedding") -> DataFrame:
    """Vector table rebuilt from the catalog: orphans removed, every complete chunk vector upserted."""
    stored = chunks.where(V.is_valid(F.col(vector_col), dimensions)).select(*keys, F.col(vector_col).alias("_new"))
    survivors = vectors.select(*keys, vector_col).join(chunks.select(*keys), list(keys), "left_semi")
    return survivors.join(stored, list(keys), "full").select(*keys, F.coalesce("_new", vector_col).alias(vector_col))


def delete_tail(rows: DataFrame, targets: DataFrame, document_col: str, from_col: str = "from_ordinal") -> DataFrame:
    """Rows left after deleting, per target document, every ordinal from ``from_col`` on (0 = all).

    ``targets`` has one row per document; negative ordinals are refused.
    """
    t = targets.select(document_col, F.when(
        F.col(from_col) < 0, F.raise_error(F.lit("from_ordinal must not be negative"))
    ).otherwise(F.col(from_col)).alias("_from"))
    kept = F.col("_from").isNull() | (F.col("ordinal") < F.col("_from"))
    return rows.join(t, document_col, "left").where(kept).drop("_from")
