"""Search over pivot cells against brute force, and how much of the corpus it reads."""

from __future__ import annotations

import numpy as np
import pytest

from ragspark.operators import cells as C
from ragspark.operators import search as S


def by_hand(corpus, queries, k):
    """Every query's best ``k`` by float32 cosine, ties by id."""
    def unit(x):
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0), n[:, 0] == 0

    (a, no_a), (b, no_b) = unit(queries), unit(corpus)
    score = np.clip((a @ b.T).astype(np.float32), -1, 1)
    score[no_a], score[:, no_b] = -1, -1
    return {(q, int(i)): r + 1 for q in range(len(a)) for r, i in enumerate(np.lexsort((np.arange(len(b)), -score[q]))[:k])}


def frames(spark, corpus, queries, extra=()):
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)] + list(extra), "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, query_vector array<double>")
    return c.repartition(3), q.repartition(2)


@pytest.mark.parametrize("part_rows, cells", [(8192, None), (5, 7), (64, 1)])
def test_cell_search_matches_brute_force(spark, monkeypatch, part_rows, cells):
    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    rng = np.random.default_rng(part_rows)
    corpus = np.concatenate((rng.normal(size=(300, 6)), np.tile(rng.normal(size=6), (60, 1)), np.zeros((4, 6))))
    queries = np.concatenate((rng.normal(size=(40, 6)), corpus[300:301], np.zeros((1, 6)), corpus[:5]))
    c, q = frames(spark, corpus, queries, [(None, [1.0] * 6), (900, None), (901, [1.0]), (902, [float("nan")] * 6)])
    index = C.build_cells(c, ["vec_id"], 6, cells=cells)
    rows = C.search_cells(index, q, ["vec_id"], ["query_id"], 6, 7).collect()
    assert {(r.query_id, r.vec_id): r["rank"] for r in rows} == by_hand(corpus, queries, 7)


def test_clustered_vectors_are_read_in_few_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 5
    corpus = np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)) * 0.1
    queries = centres[:10] + rng.normal(size=(10, 8)) * 0.1
    c, q = frames(spark, corpus, queries)
    index = C.build_cells(c, ["vec_id"], 8, cells=20)
    hits = C.search_cells(index, q, ["vec_id"], ["query_id"], 8, 5)
    assert {(r.query_id, r.vec_id): r["rank"] for r in hits.collect()} == by_hand(corpus, queries, 5)
    read = C.cells_read(index, q, ["query_id"], 8, hits, 5).collect()
    assert len(read) == 10 and sum(r.n_read for r in read) <= 0.3 * sum(r.n_cells for r in read)


def test_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c, q = frames(spark, rng.normal(size=(100, 4)), rng.normal(size=(50, 4)))
    index = C.build_cells(c, ["vec_id"], 4)
    gathered = []
    for name in ("collect", "toArrow", "toPandas", "first", "toLocalIterator"):
        monkeypatch.setattr(type(q), name, lambda self, *a, name=name: gathered.append(name))
    C.search_cells(index, q, ["vec_id"], ["query_id"], 4, 3)
    assert not gathered


def test_empty_sides(spark):
    c, q = frames(spark, np.eye(3), np.eye(3))
    assert C.search_cells(C.build_cells(c.limit(0), ["vec_id"], 3), q, ["vec_id"], ["query_id"], 3, 3).count() == 0
    assert C.search_cells(C.build_cells(c, ["vec_id"], 3), q.limit(0), ["vec_id"], ["query_id"], 3, 3).count() == 0
    assert S.search_batch(c, q, ["vec_id"], ["query_id"], 3, 2, query_bytes=1).count() == 6
