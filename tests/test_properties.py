"""Distributed forms against brute force on small random inputs, with hot keys."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.operators import chunking as K
from ragspark.operators import embedding as M
from ragspark.operators import search as S
from ragspark.operators import sequences as Q
from ragspark.operators.ordered import Ordering, Running, by_count, range_bucket, scan, with_halo
from ragspark.operators.segmentation import SpeechSegmenter


def _windows(tokens, size, overlap):
    out, start = [], 0
    while tokens[start:]:
        out.append((start, min(start + size, len(tokens)), " ".join(tokens[start:start + size])))
        if start + size >= len(tokens):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size, overlap, piece_chunks", [(5, 0, 1), (5, 2, 1), (7, 6, 2), (4, 1, 50)])
def test_chunks_equal_sequential_windows_however_texts_are_cut(spark, size, overlap, piece_chunks):
    rng = random.Random(size * 100 + overlap)
    docs = []
    for d in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 1, 4, 5, 6, 23, 80]))]
        docs.append((d, rng.choice(["", " ", "\n "]) + "".join(w + rng.choice([" ", "\n\t", " "]) for w in words)))
    df = spark.createDataFrame(docs, "d int, text string")
    got = {}
    for r in K.chunk_text(df, "d", size=size, overlap=overlap, max_token_length=4, piece_chars=20, piece_chunks=piece_chunks).orderBy("d", "ordinal").collect():
        got.setdefault(r.d, []).append((r.ordinal, r.start_token, r.end_token, r.text))
    for d, text in docs:
        tokens = [w[i:i + 4] for w in text.replace(" ", " ").split() for i in range(0, len(w), 4)]
        want = [(i, *w) for i, w in enumerate(_windows(tokens, size, overlap))]
        assert got.get(d, []) == want


def _brute_topk(ids, vectors, query, k):
    norm = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
    score = np.where(norm > 0, vectors @ query / np.where(norm > 0, norm, 1), -1).astype(np.float32)
    order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("query_bytes", [1 << 20, 8 * 6 * 7])
def test_batch_search_with_ties_equals_a_full_sort(spark, query_bytes):
    rng = np.random.default_rng(7)
    vectors = rng.integers(-2, 3, (400, 6)).astype(np.float64)  # many exact ties
    names = [f"c{i:03d}" for i in rng.permutation(400)]
    corpus = [(n, [float(x) for x in v]) for n, v in zip(names, vectors)]
    corpus += [("zz1", None), ("zz2", [1.0]), ("zz3", [float("nan")] * 6)]
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (40, 6)) + 0.5)]
    c = spark.createDataFrame(corpus, "name string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(asked, "q int, query_vector array<float>")
    rows = S.search_batch(c, q, ["name"], ["q"], 6, 7, query_bytes=query_bytes).orderBy("q", "rank").collect()
    assert len(rows) == 40 * 7
    for i, v in asked:
        assert [r.name for r in rows if r.q == i] == _brute_topk(names, vectors, np.array(v), 7)


def test_tiles_are_bounded_and_the_corpus_is_not_shuffled(spark):
    ids = pa.table({"q": range(1300)})
    tiles = S._tiles(ids, np.ones((1300, 3)), 2)
    assert [len(t.unit) for t in tiles] == [512, 512, 276]
    assert [t.query_ids.column("q")[0].as_py() for t in tiles] == [0, 512, 1024]
    c = spark.range(50).selectExpr("id", "array(cast(id as float), 1f) as embedding")
    q = spark.range(40).selectExpr("id as q", "array(1f, cast(id as float)) as query_vector")
    plan = S.search_batch(c, q, ["id"], ["q"], 2, 3)._jdf.queryExecution().executedPlan().toString()
    scoring = [i for i, line in enumerate(plan.splitlines()) if "MapInArrow" in line]
    assert len(scoring) == 1
    assert all("Exchange" not in line for line in plan.splitlines()[scoring[0]:])


def test_a_task_holds_one_block_of_many_queries(spark, monkeypatch):
    build, most = S._tiles, 40
    monkeypatch.setattr(S, "BLOCK_BYTES", 8 * 6 * 20)

    def bounded(ids, matrix, k, floor=None):
        if len(matrix) > most:
            raise AssertionError(f"{len(matrix)} queries in one task")
        return build(ids, matrix, k, floor)

    monkeypatch.setattr(S, "_tiles", bounded)
    rng = np.random.default_rng(9)
    vectors = np.concatenate((rng.integers(-2, 3, (300, 6)), np.tile([1, 0, 2, 0, 0, 1], (50, 1)))).astype(np.float64)
    names = [f"c{i:03d}" for i in rng.permutation(350)]
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (150, 6)) + 0.5)]
    c = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, vectors)] + [(None, [1.0] * 6)], "name string, embedding array<float>")
    q = spark.createDataFrame([*asked, (None, [1.0] * 6), (900, None)], "q int, query_vector array<double>")
    rows = S.search_batch(c.repartition(3), q, ["name"], ["q"], 6, 7, query_bytes=1).orderBy("q", "rank").collect()
    assert len(rows) == 150 * 7
    for i, v in asked:
        assert [r.name for r in rows if r.q == i] == _brute_topk(names, vectors, np.array(v), 7)


def test_many_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    c = spark.range(50).selectExpr("id", "transform(sequence(1, 64), x -> cast(id % x as float)) as embedding")
    q = spark.range(40_000).selectExpr("id as q", "transform(sequence(1, 64), x -> cast(id % x as float)) as query_vector")
    gathered = []
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(q), name, lambda self, *a, name=name: gathered.append(name))
    S.search_batch(c, q, ["id"], ["q"], 64)
    assert not gathered


def test_search_leaves_null_ids_and_bad_vectors_out(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (None, [1.0, 0.0]), (8, None)], "q int, query_vector array<float>")
    assert [(r.q, r.id) for r in S.search_batch(c, q, ["id"], ["q"], 2).collect()] == [(9, 1)]
    assert S.search_batch(c, q.where("q < 0"), ["id"], ["q"], 2).collect() == []


def test_search_with_fewer_rows_than_k(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q int, query_vector array<float>")
    assert [(r.id, r.score) for r in S.search_batch(c, q, ["id"], ["q"], 2, 5).orderBy("rank").collect()] == [(1, 1.0), (2, -1.0)]
    assert [(r.id, r.score) for r in S.search(c, [1.0, 0.0], ["id"], 5).collect()] == [(1, 1.0), (2, -1.0)]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = 0 if rng.random() < 0.6 else rng.randint(1, 30)
        rows.append((key, rng.randint(0, 5000), i, rng.randint(0, 3), None if rng.random() < 0.4 else rng.randint(0, 99)))
    df = spark.createDataFrame(rows, "k int, t int, id int, s int, v int")
    return df.withColumn("_bucket", range_bucket(F.col("t"), 137)).cache()


BY = Ordering(("k",), ("t", "id"))


def test_scans_equal_plain_windows_on_a_hot_key(events):
    got = scan(events, BY, {
        "total": Running("sum", F.col("v")), "before": Running("sum", F.col("v"), inclusive=False), "top": Running("max", F.col("v")),
        "low": Running("min", F.col("v"), inclusive=False), "seen": Running("last", F.col("v")), "prev": Running("last", F.col("id"), inclusive=False),
    })
    w = Window.partitionBy("k").orderBy("t", "id")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = events.select(
        *events.columns, F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("before"),
        F.max("v").over(upto).alias("top"), F.min("v").over(earlier).alias("low"), F.last("v", True).over(upto).alias("seen"), F.lag("id").over(w).alias("prev"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_reverse_scan_is_lead(events):
    got = scan(events, BY, {"next": Running("last", F.col("id"), inclusive=False)}, reverse=True)
    want = events.select(*events.columns, F.lead("id").over(Window.partitionBy("k").orderBy("t", "id")).alias("next"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_halo_windows_are_exact(events):
    rows = Q.with_index(events, BY)
    got = Q.pre_roll(rows, ["k"], "id", block_rows=16).select("k", "seq", "pre_roll")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(-7, 0)
    want = rows.select("k", "seq", F.collect_list("id").over(w))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        with_halo(rows, "seq", 4, 4)


def _frames(rng, n):
    out, loud = [], False
    while len(out) < n:
        run = rng.choice([1, 1, 2, 3, 10, 34, 35, 36, 42, 43, 44, 60, 120])
        out += [loud] * run
        loud = not loud
    return out[:n]


@pytest.mark.parametrize("seed", range(4))
def test_segments_equal_one_machine_over_the_whole_stream(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for stream in range(4):
        frames = [True] * 2000 if stream == 3 else _frames(rng, 2500)  # stream 3 never pauses
        machine = SpeechSegmenter()
        for seq, loud in enumerate(frames, 1):
            rows.append((stream, seq, loud))
            want += [(stream, *u) for u in machine.push(seq, loud, 320, seq * 20)]
        want += [(stream, *u) for u in machine.flush()]
    df = spark.createDataFrame(rows, "stream int, seq long, loud boolean").withColumn("b", range_bucket(F.col("seq"), 100))
    got = Q.utterances(df, Ordering(("stream",), ("seq",), "b"), F.col("loud"), F.lit(320), F.col("seq") * 20)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[6] for w in want} >= {"SILENCE", "MAX_LENGTH", "CADENCE"}


@pytest.mark.parametrize("block_rows", [44, 64, 333])
def test_segments_do_not_depend_on_blocks(spark, block_rows):
    """Utterances over many blocks, resets and openings at every place of one, frames of any size, wandering clocks."""
    rng = random.Random(block_rows)
    rows, want = [], []
    for stream in range(12):
        frames = [True] * 1500 if stream % 4 == 3 else _frames(rng, (1, 44, 700, 0, 1500, 900)[stream % 6])
        sizes = [[0], [320], [9_000, 100_000], [0, 4_000, 30_000], [500_000]][stream % 5]
        machine, now = SpeechSegmenter(), 0
        for seq, loud in enumerate(frames, 1):
            n = rng.choice(sizes)
            now += rng.choice([20, 20, 700, -600])
            rows.append((stream, seq, loud, n, now))
            want += [(stream, *u) for u in machine.push(seq, loud, n, now)]
        want += [(stream, *u) for u in machine.flush()]
    df = spark.createDataFrame(rows, "stream int, seq long, loud boolean, n int, t long")
    got = Q.utterances(df, Ordering(("stream",), ("seq",)), F.col("loud"), F.col("n"), F.col("t"), block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[6] for w in want} == {"SILENCE", "MAX_LENGTH", "CADENCE", "END_OF_STREAM"}


def test_segments_of_nulls_and_nothing(spark):
    by = Ordering(("stream",), ("seq",))
    empty = spark.createDataFrame([], "stream int, seq long, loud boolean, n int, t long")
    assert Q.utterances(empty, by, F.col("loud"), F.col("n"), F.col("t")).count() == 0
    rows = [(1, i, True, 8_000, None) for i in range(1, 4)] + [(1, 4, None, None, None), (1, 5, True, -5, None)]
    df = spark.createDataFrame(rows, empty.schema)
    got = Q.utterances(df, by, F.col("loud"), F.col("n"), F.col("t"))
    assert list(map(tuple, got.collect())) == [(1, "FINAL", 1, 5, 5, 24_000, "END_OF_STREAM")]


def test_a_stream_without_pauses_is_many_tasks_and_one_shuffle(spark):
    df = spark.range(1, 20_001).select(F.lit("hot").alias("stream"), F.col("id").alias("seq"))
    got = Q.utterances(df, Ordering(("stream",), ("seq",)), F.lit(True), F.lit(320), F.col("seq") * 20, block_rows=256)
    assert sum(r.n_frames for r in got.collect() if r.kind == "FINAL") == 20_000
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the maps and the utterances are taken from one exchange of frames, by key and block
    assert final.count("ReusedExchange") == 1 and final.count("Range (") == 1


def test_a_busy_day_is_many_buckets(spark):
    """All rows of one user at one time: buckets by count split them, and running values are those of the plain window."""
    rng = random.Random(11)
    rows = [("hot", 5, i, rng.randint(0, 9)) for i in range(3000)] + [(k, i % 3, i, i) for k in ("a", "z") for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, day int, id int, v int")
    placed, by = by_count(df, ["k"], ["day", "id"], block_rows_log2=6)
    sizes = [r["count"] for r in placed.groupBy("k", by.bucket).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 64
    w = Window.partitionBy("k").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, 0)
    got = Q.with_index(scan(placed, by, {"top": Running("max", F.col("v")), "s": Running("sum", F.col("v"))}), by)
    want = df.select("k", "id", F.max("v").over(w), F.sum("v").over(w), F.count("*").over(w))
    assert sorted(map(tuple, got.select("k", "id", "top", "s", "seq").collect())) == sorted(map(tuple, want.collect()))


def test_progress_starts_over_for_each_key_and_shows_completion(spark):
    rows = [("a", i, i * 400_000, 4_000_000) for i in range(11)] + [("b", 0, 10, 500), ("b", 1, 20, 500), ("b", 2, 500, 500)]
    df = spark.createDataFrame(rows, "k string, i int, done long, total long")
    got = sorted((r.k, r.done) for r in Q.progress_steps(df, ["k"], "i", "done", "total").collect())
    assert got == [("a", 0), ("a", 1_200_000), ("a", 2_400_000), ("a", 3_600_000), ("a", 4_000_000), ("b", 10), ("b", 500)]


def test_debounce_boundary(spark):
    df = spark.createDataFrame([("k", 0, 0, "a"), ("k", 299, 0, "b"), ("k", 599, 0, " ")], "k string, t long, _bucket long, text string")
    got = Q.debounce(df, Ordering(("k",), ("t",)), "t", 300, "text").orderBy("t").collect()
    assert [(r.t, r.action) for r in got] == [(299, "FIRE"), (599, "CLEAR")]


def test_only_the_current_generation_survives(spark):
    results = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new"), ("s", 2, "more")], "k string, g int, text string")
    assert sorted(r.text for r in Q.latest_wins(results, ["k"], "g").collect()) == ["more", "new"]
    issued = spark.createDataFrame([("s", 3)], "k string, g int")
    assert Q.latest_wins(results, ["k"], "g", issued).count() == 0


def test_limits_are_whole(spark):
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id"))
    assert [r.id for r in Q.drop_oldest(df, ["k"], ["id"]).orderBy("id").collect()] == list(range(200 - X.QUEUE_FRAMES, 200))


def test_frames_in_flight(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in ("hot", "b", "c"):
        t = free = 0
        for i in range(3000 if k == "hot" else 40):
            t += rng.choice([0, 1, 5, 40])
            busy = rng.choice([0, 3, 30, 60])
            rows.append((k, i, t, t // 100, busy))
            if i == 0 or t >= free:
                free = t + busy
                want.append((k, i))
    df = spark.createDataFrame(rows, "k string, i int, t long, _bucket long, busy long")
    got = Q.single_flight(df, Ordering(("k",), ("t", "i")), "t", "busy")
    assert got.columns == df.columns
    assert sorted((r.k, r.i) for r in got.collect()) == sorted(want)
    assert Q.single_flight(df.limit(0), Ordering(("k",), ("t", "i")), "t", "busy").count() == 0


def test_progress_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows, want = [], []
    for k in ("a", "b"):
        total, done, shown = 500_000_000, 0, None
        for i in range(2500):
            done += rng.choice([0, 10, 90_000, 700_000, -50_000])
            size = total if i in (700, 701, 2499) else max(0, done)
            rows.append((k, i, size, total))
            if shown is None or size == total or size - shown >= X.PROGRESS_STEP_BYTES:
                shown = size
                want.append((k, i))
    df = spark.createDataFrame(rows, "k string, i int, done long, total long")
    assert sorted((r.k, r.i) for r in Q.progress_steps(df, ["k"], "i", "done", "total").collect()) == sorted(want)


def _pieces_by_hand(word, ids, unknown):
    if len(word) > 100:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        prefix = "##" if at else ""
        cut = next((e for e in range(len(word), at, -1) if prefix + word[at:e] in ids), None)
        if cut is None:
            return [unknown]
        out.append(ids[prefix + word[at:cut]])
        at = cut
    return out


@pytest.mark.parametrize("piece", [1 << 20, 128])
def test_longest_match_of_many_words_equals_the_plain_one(monkeypatch, piece):
    from ragspark.operators import wordpiece as W

    monkeypatch.setattr(W, "PIECE", piece)
    rng = random.Random(piece)
    letters = "abcé漢𝒳"

    def draw(n):
        return "".join(rng.choice(letters) for _ in range(n))

    tokens = {draw(rng.randint(1, 6)) for _ in range(150)} | {"##" + draw(rng.randint(1, 5)) for _ in range(150)} | {"##", "a" * 99, "##c" + "b" * 98}
    ids = {t: i for i, t in enumerate(sorted(tokens))}
    words = [draw(rng.randint(1, 14)) for _ in range(3000)] + ["a" * 99, "a" * 100, "c" * 101, "zzz", "##a", "", "a" + "c" + "b" * 98]
    found, counts = W.Pieces(ids, 777).encode(pa.array(words))
    want = [_pieces_by_hand(w, ids, 777) for w in words]
    assert counts.tolist() == [len(x) for x in want]
    assert found.tolist() == [i for x in want for i in x]


def _shown(rows, step):
    """(sizes, goals) in order -> positions shown, one row at a time."""
    last, out = -step, []
    for i, (size, goal) in enumerate(rows):
        if size is not None and (size == goal or size - last >= step):
            out.append(i)
            last = size
    return out


def test_last_shown_is_that_of_the_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        n, step = rng.randint(1, 40), rng.randint(1, 12)
        sizes = [rng.randint(-5, 60) for _ in range(n)] if rng.random() < 0.5 else sorted(rng.randint(0, 60) for _ in range(n))
        complete = [rng.random() < 0.05 for _ in range(n)]
        upto, shown = Q._last_shown(np.array(sizes, np.int64), np.array(complete), step)
        assert (np.diff(upto) > 0).all()
        for before in range(-step, 70):
            last = before
            for size, full in zip(sizes, complete):
                if full or size - last >= step:
                    last = size
            k = int(np.searchsorted(upto, before + step))
            assert (int(shown[k]) if k < len(upto) else before) == last


def test_progress_of_a_hot_key_is_found_block_by_block(spark):
    """One key in very small blocks, nulls and falling sizes included, equals the plain loop; extra columns stay."""
    rng = random.Random(6)
    data = {key: [(None if rng.random() < 0.05 else i * 3 - rng.choice([0, 0, 0, 40]), 3 * n) for i in range(n + 1)]
            for key, n in (("hot", 700), ("a", 3), ("b", 20), ("z", 64))}
    rows = [(k, i, size, goal, i % 3) for k, part in data.items() for i, (size, goal) in enumerate(part)]
    df = spark.createDataFrame(rows, "key string, at int, done bigint, total bigint, _look int")
    got = Q.progress_steps(df, ["key"], "at", "done", "total", step=25, block_rows_log2=4)
    assert got.columns == df.columns
    want = {(k, i) for k, part in data.items() for i in _shown(part, 25)}
    assert {(r.key, r["at"]) for r in got.collect()} == want and got.count() == len(want)
    assert Q.progress_steps(df.limit(0), ["key"], "at", "done", "total").isEmpty()


def test_batches_of_tokens_are_read_in_bounded_blocks():
    rng = random.Random(8)
    rows = [None if i % 9 == 4 else [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 7, 40]))] for i in range(300)]
    for tokens in (pa.array(rows, pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string())).slice(11, 200)):
        parts = list(M.token_blocks(tokens, 50))
        assert pa.concat_arrays(parts).equals(tokens)
        assert max(len(p.flatten()) for p in parts) <= 50 and len(parts) < len(tokens) / 2
        assert pa.concat_arrays([M._hash_counts(p, 16) for p in parts]).equals(M._hash_counts(tokens, 16))
    assert [len(p) for p in M.token_blocks(pa.array([["a"] * 60, ["b"] * 60], pa.list_(pa.string())), 50)] == [1, 1]
    assert [len(p) for p in M.token_blocks(pa.array([], pa.list_(pa.string())), 50)] == [0]
