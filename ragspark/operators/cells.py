"""Exact cosine search over vectors kept in pivot cells.

Vectors are kept in the cell of their nearest pivot, with each cell's number of rows and its least and largest
angle to the pivot.  Angles obey the triangle inequality, so a query at angle ``a`` to a pivot lies at least
``max(a - largest, least - a)`` from every vector of the cell.  A query first reads its nearest cells, as many as
hold ``k`` vectors; the k-th score found there is a floor under the final one, and of the other cells only those
are read whose bound reaches the floor.  The result is exact, ties included: a bound has a little slack.

Queries travel as rows to the parts of the cells they read; neither queries nor corpus pass through the driver,
and the corpus is read twice whatever the number of queries.  A part holds about ``PART_ROWS`` vectors, so a cell
with very many equal vectors is several parts; a task holds one part and streams its queries.

The pivots come from a sample of at most ``SAMPLE_PER_CELL`` vectors a cell and at most ``MAX_CELLS`` cells; they
decide how much is read, never what is found.  Vectors without a direction (zero) score -1 against everything
and have a cell of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import vectors as V
from ragspark.operators import search as S
from ragspark.sources.tables import written

MAX_CELLS = 1024
SAMPLE_PER_CELL = 32
PART_ROWS = 8192
SLACK = 1e-6


@dataclass
class Cells:
    """Stored rows (``id_cols``, vector, ``cell``, ``part``) and what routing needs to know of the cells."""

    rows: DataFrame
    pivots: np.ndarray  # unit vectors
    least: np.ndarray
    largest: np.ndarray
    count: np.ndarray
    first_part: np.ndarray  # number of a cell's first part, and one more entry at the end

    def bounds(self, unit: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles to the pivots and the largest score in each cell, for unit queries; the last cell has no direction."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))
        away = np.maximum(np.maximum(angle - self.largest, self.least - angle), 0)
        top = np.concatenate((np.cos(away), np.full((len(unit), 1), -1.0)), axis=1) + SLACK
        angle = np.concatenate((angle, np.full((len(unit), 1), 4.0)), axis=1)
        top[bad] = -1.0 + SLACK
        top[:, self.count == 0] = -np.inf
        angle[:, self.count == 0] = np.inf
        return angle, top

    def nearest(self, angle: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query reads first: the nearest that together hold ``k`` rows."""
        order = np.argsort(angle, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        chosen = np.zeros(angle.shape, bool)
        np.put_along_axis(chosen, order, held - self.count[order] < k, axis=1)
        return chosen & (self.count > 0)


def _fit(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Unit pivots by spherical k-means."""
    pivots = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        unit, bad = S._unit(sums)
        pivots = np.where(bad[:, None], pivots, unit)
    return pivots


def _assign(pivots: np.ndarray, dimensions: int, id_cols: Sequence[str], vector_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, where = S._matrix(batch.column(vector_col), dimensions)
            unit, bad = S._unit(matrix)
            score = unit @ pivots.T
            cell = np.where(bad, len(pivots), score.argmax(axis=1)) if len(unit) else np.empty(0, np.int64)
            angle = np.where(bad, 0.0, np.arccos(np.clip(score.max(axis=1, initial=-1.0), -1, 1)))
            kept = batch.take(pa.array(where))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=[*kept.schema.names, "cell", "angle"])

    return run


def build_cells(corpus: DataFrame, id_cols: Sequence[str], dimensions: int, vector_col: str = "embedding",
                cells: int | None = None) -> Cells:
    """Deal a corpus into cells and write it.  Rows with a null id or a vector that cannot be searched are left out."""
    id_cols = list(id_cols)
    narrow = corpus.select(*id_cols, vector_col).where(" AND ".join(f"`{c}` IS NOT NULL" for c in id_cols))
    total = narrow.count()
    cells = min(MAX_CELLS, max(1, cells or round(math.sqrt(total) / 2)))
    ticket = F.pmod(F.xxhash64(*id_cols), F.lit(1 << 30))
    share = min(1.0, SAMPLE_PER_CELL * cells / max(total, 1))
    drawn = narrow.where(V.is_valid(F.col(vector_col), dimensions) & (ticket < share * (1 << 30))).select(vector_col)
    sample, bad = S._unit(S._matrix(drawn.limit(2 * SAMPLE_PER_CELL * cells).toArrow().column(vector_col), dimensions)[0])
    sample = sample[~bad]
    pivots = _fit(sample, min(cells, len(sample))) if len(sample) else np.eye(1, dimensions)
    schema = T.StructType([*narrow.schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    rows = written(narrow.mapInArrow(_assign(pivots, dimensions, id_cols, vector_col), schema), "cells")
    n = len(pivots) + 1
    count, least, largest = np.zeros(n, np.int64), np.zeros(n - 1), np.zeros(n - 1)
    for cell, size, low, high in rows.groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle")).collect():
        count[cell] = size
        if cell < n - 1:
            least[cell], largest[cell] = low, high
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(-(-count // PART_ROWS))))
    starts, parts = (F.array(*[F.lit(int(x)) for x in v]) for v in (first[:-1], np.maximum(1, np.diff(first))))
    part = (starts[F.col("cell")] + F.pmod(F.xxhash64(*id_cols), parts[F.col("cell")])).cast("int")
    return Cells(rows.select(*id_cols, vector_col, part.alias("part")), pivots, least, largest, count, first)


def _route(index: Cells, k: int, dimensions: int, query_cols: Sequence[str], vector_col: str, second: bool):
    """A row of each query for each part it reads; in the second reading ``floor`` says which cells can matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, S.TILE_QUERIES):
                part = batch.slice(start, S.TILE_QUERIES)
                matrix, where = S._matrix(part.column(vector_col), dimensions)
                if not len(matrix):
                    continue
                angle, top = index.bounds(*S._unit(matrix))
                chosen = index.nearest(angle, k)
                floor = np.full(len(matrix), -np.inf, np.float32)
                if second:
                    floor = part.column("floor").to_numpy(zero_copy_only=False)[where]
                    chosen = ~chosen & (top >= floor[:, None]) & (index.count > 0)
                query, cell = np.nonzero(chosen)
                parts = np.diff(index.first_part)[cell]
                query = np.repeat(query, parts)
                number = np.repeat(index.first_part[cell] - np.cumsum(parts) + parts, parts) + np.arange(len(query))
                rows = part.select([*query_cols, vector_col]).take(pa.array(where[query]))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(number, pa.int32()), pa.array(floor[query], pa.float32())],
                    names=[*query_cols, "vector", "part", "floor"])

    return run


def _score_parts(k: int, dimensions: int, id_cols: Sequence[str], query_cols: Sequence[str], columns: Sequence[str]):
    """Rows sorted by part, vectors (``kind`` 0) before queries: the best ``k`` of each query in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(kind, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(part)]):
                if part[i] != now:
                    now, held, ready = part[i], [], None
                rows = batch.slice(i, j - i)
                if kind[i] == 0:
                    held.append(rows)
                elif held:
                    if ready is None:
                        table = pa.Table.from_batches(held)
                        matrix, where = S._matrix(table.column("vector"), dimensions)
                        ready = table.select(list(id_cols)).take(pa.array(where)), *S._unit(matrix)
                    yield from best(rows, *ready)

    def best(rows, ids, unit, bad):
        asked = pa.Table.from_batches([rows])
        for tile in S._tiles(asked.select(list(query_cols)), S._matrix(asked.column("vector"), dimensions)[0], k,
                             asked.column("floor").to_numpy()):
            for start in range(0, len(unit), S.TILE_ROWS):
                end = start + S.TILE_ROWS
                tile.add(ids.slice(start, S.TILE_ROWS), unit[start:end], bad[start:end])
            yield from tile.result(columns)

    return run


def _top(hits: DataFrame, query_cols: Sequence[str], id_cols: Sequence[str], k: int) -> DataFrame:
    best = Window.partitionBy(*query_cols).orderBy(F.desc("score"), *id_cols)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_cells(index: Cells, queries: DataFrame, id_cols: Sequence[str], query_cols: Sequence[str], dimensions: int,
                 k: int = S.DEFAULT_K, vector_col: str = "embedding", query_vector_col: str = "query_vector") -> DataFrame:
    """``query ids, corpus ids, score, rank`` of the exact top ``k`` for every query; equal to ``search.search_batch``."""
    S.check_k(k)
    id_cols, query_cols = list(id_cols), list(query_cols)
    asked = queries.select(*query_cols, query_vector_col).where(
        " AND ".join(f"`{c}` IS NOT NULL" for c in query_cols)).where(V.is_valid(F.col(query_vector_col), dimensions))
    fields = {f.name: f for f in [*asked.schema, *index.rows.schema]}
    routed = T.StructType([*(fields[c] for c in query_cols), T.StructField("vector", asked.schema[query_vector_col].dataType),
                           T.StructField("part", T.IntegerType()), T.StructField("floor", T.FloatType())])
    found = T.StructType([*(fields[c] for c in (*query_cols, *id_cols)), T.StructField("score", T.FloatType())])
    spark = queries.sparkSession
    known = Cells(None, index.pivots, index.least, index.largest, index.count, index.first_part)  # a table cannot travel

    def nothing(columns: Sequence[str]) -> list[Column]:
        return [F.lit(None).cast(fields[c].dataType).alias(c) for c in columns]

    vectors = index.rows.select(
        "part", F.lit(0).alias("kind"), *id_cols, *nothing(query_cols), F.col(vector_col).alias("vector"), F.lit(None).cast("float").alias("floor"))

    def read(asked: DataFrame, second: bool) -> DataFrame:
        routes = asked.mapInArrow(_route(known, k, dimensions, query_cols, query_vector_col, second), routed)
        both = vectors.unionByName(routes.select("part", F.lit(1).alias("kind"), *nothing(id_cols), *query_cols, "vector", "floor"))
        size = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(size, "part").sortWithinPartitions("part", "kind")
        return dealt.mapInArrow(_score_parts(k, dimensions, id_cols, query_cols, found.names), found)

    # used twice over one exchange: the first reading is scored once
    first = _top(read(asked, False), query_cols, id_cols, k).drop("rank")
    floors = first.groupBy(*query_cols).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf")).cast("float")).alias("floor"))
    rest = asked.join(floors, query_cols, "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")).cast("float")))
    return _top(first.unionByName(read(rest, True)), query_cols, id_cols, k)


def cells_read(index: Cells, queries: DataFrame, query_cols: Sequence[str], dimensions: int, hits: DataFrame, k: int,
               query_vector_col: str = "query_vector") -> DataFrame:
    """``query ids, n_cells, n_read``: how many of the cells that hold vectors each query had to read for ``hits``."""
    query_cols = list(query_cols)
    final = hits.groupBy(*query_cols).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf")).cast("float")).alias("floor"))
    rows = queries.select(*query_cols, query_vector_col).join(final, query_cols)
    known = Cells(None, index.pivots, index.least, index.largest, index.count, index.first_part)
    schema = T.StructType([*(queries.schema[c] for c in query_cols), T.StructField("n_cells", T.LongType()), T.StructField("n_read", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, where = S._matrix(batch.column(query_vector_col), dimensions)
            angle, top = known.bounds(*S._unit(matrix))
            floor = batch.column("floor").to_numpy(zero_copy_only=False)[where]
            read = (known.nearest(angle, k) | (top >= floor[:, None])) & (known.count > 0)
            ids = batch.select(query_cols).take(pa.array(where))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(np.full(len(read), int((known.count > 0).sum()))), pa.array(read.sum(axis=1))], names=schema.names)

    return rows.mapInArrow(run, schema)
