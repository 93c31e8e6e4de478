"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Components become integers (``floor(scale * x)``) and a row's score is its inner product with the anchor.  An
anchor's positives are its best other rows of the same label; each positive opens a window of scores, from
``low`` to ``high`` percent of its own, in which the best rows of other labels are its negatives.

A block of candidates keeps one list of its rows for each dimension, sorted by component.  An anchor reads each
list from its high end where its own component is positive and from its low end where it is negative, so what
the component adds to the score falls along every list.  Rows met for the first time are scored whole.  The sum
of the last contributions read is the threshold: no unread row scores more.  Reading stops once the threshold is
strictly below the k-th score of every window, so that equal scores still meet and the smaller id wins, or
below the window's lower end.  The k-th scores go on from block to block.

Anchors and candidates meet in a grid of cells: ``ANCHORS`` anchors by one share of the candidates.  A task
holds the anchors of its cell and streams the candidates in blocks of ``BLOCK`` rows, so its memory follows
neither table; each cell returns the best of every window and a window function merges the cells.  The first
pass over the grid finds positives, the second one negatives.

Scores are exact: float32 or float64 where the norms bound every partial sum below 2^24 or 2^53, else 64-bit
integers (scores beyond 64 bits have no defined result).

Edge cases: rows with a null label, vector or ``vec_id`` and rows with a null or non-finite component take no
part; missing trailing components count as 0, an empty vector scores 0 everywhere.  Repeated rows are rows of
their own: each is an anchor and a candidate, and a copy of an anchor is an other row.  Ties go to the smaller
``vec_id``.  A positive whose score is negative has an empty window.  Anchors without positives, positives
without negatives and empty tables give no rows.  Extra columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.shared import cut, partitions

ANCHORS = 1 << 15  # anchors of a cell
BLOCK = 1 << 14  # candidates whose lists are sorted together
FIRST_READ = 32  # rows read of each list before the first look at the threshold


class Block:
    """Candidates with their sorted lists; list d falls along dimension d, list D + d rises."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.labels, self.rows = vectors, ids, labels, rows
        up = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.lists = np.ascontiguousarray(np.concatenate((up[:, ::-1], up)))
        rising = np.sort(vectors, axis=0).T
        self.values = np.ascontiguousarray(np.concatenate((rising[:, ::-1], rising)))
        self.reader = np.full(len(ids), -1, np.int64)  # who has read a row last
        self.place = np.zeros(len(ids), np.int64)

    def fresh(self, found: np.ndarray, reader: int) -> np.ndarray:
        """Rows of ``found`` that this reader has not met, each once."""
        new = found[self.reader[found] != reader]
        at = np.arange(len(new))
        self.place[new] = at
        new = new[self.place[new] == at]
        self.reader[new] = reader
        return new


class Best:
    """The best ``k`` of one window: score falling, id rising; row numbers order copies."""

    def __init__(self, k: int, floor: int | None = None, top: int | None = None):
        """Scores from ``floor / 100`` to ``top / 100``; no bound where None."""
        self.k, self.floor, self.top = k, floor, top
        self.score = self.id = self.row = np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.floor is not None:
            inside = (100 * score >= self.floor) & (100 * score <= self.top)
            score, ids, rows = score[inside], ids[inside], rows[inside]
        if len(self.score) == self.k:
            rival = score >= self.score[-1]
            score, ids, rows = score[rival], ids[rival], rows[rival]
        if len(score):
            score, ids, rows = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.row, rows)))
            first = np.lexsort((rows, ids, -score))[: self.k]
            self.score, self.id, self.row = score[first], ids[first], rows[first]

    def closed(self, threshold: int) -> bool:
        """No row that scores ``threshold`` or less can still enter."""
        if len(self.score) == self.k and threshold < self.score[-1]:
            return True
        return self.floor is not None and 100 * threshold < self.floor


def read_lists(block: Block, anchor: np.ndarray, reader: int, usable, windows: list[Best]) -> int:
    """Sorted access until every window is closed; ``usable`` tells which rows count.  Returns the rows of each list read."""
    size, dims = block.vectors.shape
    own = np.flatnonzero(anchor)
    if not len(own):  # every row scores zero: one list holds them all
        own = np.zeros(1, np.int64)
    weights = anchor[own]
    chosen = np.where(weights >= 0, own, own + dims)
    depth = met = 0
    while depth < size and met < size:
        until = min(size, depth + max(FIRST_READ, depth // 2))
        new = block.fresh(block.lists[chosen, depth:until].ravel(), reader)
        met += len(new)
        depth = until
        rows = new[usable(new)]
        if len(rows):
            score = (block.vectors[rows] @ anchor).astype(np.int64)
            for window in windows:
                window.add(score, block.ids[rows], block.rows[rows])
        threshold = int(weights @ block.values[chosen, depth - 1])
        if all(window.closed(threshold) for window in windows):
            break
    return depth


def exact_type(vectors: np.ndarray, anchors: np.ndarray):
    """The fastest type in which all products and partial sums of both sides are exact."""
    def norm(x: np.ndarray) -> float:
        return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))

    bound = 1.001 * norm(vectors) * norm(anchors) + max(norm(vectors), norm(anchors))
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of a list column, zeros after short ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)), 1)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def search_cell(k: int, negatives: bool, low: int, high: int):
    """One cell of the grid: its anchors come first (``kind`` 0), then its candidates in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        size, anchors = 0, None
        for batch in batches:
            split = int(np.count_nonzero(batch.column("kind").to_numpy() == 0))
            if split:
                held.append(batch.slice(0, split))
            while split < batch.num_rows:
                part = batch.slice(split, BLOCK - size)
                waiting.append(part)
                split, size = split + part.num_rows, size + part.num_rows
                if size == BLOCK:
                    anchors = anchors or opened(held)
                    read(anchors, waiting)
                    waiting, size = [], 0
        if waiting and held:
            anchors = anchors or opened(held)
            read(anchors, waiting)
        if anchors:
            yield from results(*anchors)

    def opened(held):
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = matrix(table.column("vector").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64())))
        if negatives:
            lists = [[x["score"] for x in scores] for scores in table.column("positives").to_pylist()]
            windows = [[Best(k, low * s, high * s) for s in scores] for scores in lists]
        else:
            windows = [[Best(k)] for _ in range(table.num_rows)]
        return table, vectors, windows

    def read(anchors, waiting):
        table, vectors, windows = anchors
        found = pa.Table.from_batches(waiting).combine_chunks()
        rows = found.column("row").to_numpy()
        matter = matrix(found.column("vector").chunk(0), vectors.shape[1])
        kind = exact_type(matter, vectors)
        block = Block(matter.astype(kind), found.column("id").to_numpy(), found.column("label").to_numpy(), rows)
        wide = widened(vectors, matter.shape[1]).astype(kind)
        labels, own = table.column("label").to_numpy(), table.column("row").to_numpy()
        for i in range(len(wide)):
            live = [w for w in windows[i] if w.floor is None or w.floor <= w.top]
            if not live:
                continue
            if negatives:
                read_lists(block, wide[i], i, lambda x: block.labels[x] != labels[i], live)
            else:
                read_lists(block, wide[i], i, lambda x: (block.labels[x] == labels[i]) & (rows[x] != own[i]), live)

    def results(table, vectors, windows):
        own = table.column("row").to_pylist()
        for i in range(0, len(own), 1024):
            flat = [(a, j, s, d, r) for a, found in zip(own[i : i + 1024], windows[i : i + 1024])
                    for j, w in enumerate(found) for s, d, r in zip(w.score.tolist(), w.id.tolist(), w.row.tolist())]
            columns = list(zip(*flat)) if flat else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "window", "score", "id", "row"])

    return run


def grid_search(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_rows: int, k: int, negatives: bool, low: int, high: int) -> DataFrame:
    """``anchor, window, score, id, row, rank``: the best ``k`` of every window over all candidates."""
    groups = max(1, math.ceil(n_anchors / ANCHORS))
    shares = max(1, min(math.ceil(n_rows / BLOCK), math.ceil(2 * partitions(anchors.sparkSession) / groups)))

    def dealt(row: str, n: int) -> Column:
        return F.pmod(F.xxhash64(row), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    columns = ["cell", "kind", "row", "id", "label", "vector", "positives"]
    left = anchors.withColumn("share", every(shares)).select(
        (dealt("row", groups) * shares + F.col("share")).alias("cell"), F.lit(0).alias("kind"), *columns[2:])
    right = candidates.withColumn("group", every(groups)).select(
        (F.col("group") * shares + dealt("row", shares)).alias("cell"), F.lit(1).alias("kind"), *columns[2:6],
        F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"))
    cells = left.unionByName(right).repartitionById(groups * shares, F.col("cell")).sortWithinPartitions("kind")
    found = cells.mapInArrow(search_cell(k, negatives, low, high), "anchor long, window int, score long, id long, row long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    ``is_anchor`` is a condition on ``vec_id``.  A negative's score lies from ``low`` to ``high`` percent of its positive's.
    """
    values = vectors["embedding"].cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut(vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), values.alias("values"), fine.alias("fine"),
    ).where("fine and vec_id is not null and label is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), "label",
        F.transform("values", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"), is_anchor.alias("is_anchor"),
    ))
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    candidates = rows.drop("is_anchor")
    anchors = rows.where("is_anchor").drop("is_anchor")
    scored = "array<struct<rank:int,id:bigint,score:bigint>>"
    near = grid_search(anchors.withColumn("positives", F.lit(None).cast(scored)), candidates, n_anchors, n_rows, positives, False, low, high)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asked = cut(anchors.join(near, anchors["row"] == near["anchor"]).select("row", "id", "label", "vector", "positives"))
    found = grid_search(asked, candidates, n_anchors, n_rows, negatives, True, low, high)
    named = asked.select(F.col("row").alias("own"), F.col("id").alias("anchor_id"), "positives")
    return found.join(named, found["anchor"] == named["own"]).select(
        "anchor_id", F.col("positives")[F.col("window")]["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("positives")[F.col("window")]["score"].alias("positive_score"), F.col("score").alias("negative_score"))
