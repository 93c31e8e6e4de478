"""Streaming forms against the batch forms over replayed files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ragspark.operators.embedding import HashedBagOfWords
from ragspark.operators.segmentation import SpeechSegmenter
from ragspark.streaming import debounce as D
from ragspark.streaming import segments, sinks


def _stream(spark, df, tmp_path, parts=3, order="id"):
    """Write the rows as several ordered files, one per trigger."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def _finish(writer):
    """Run once over what is there."""
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60), "query did not finish"
    finally:
        q.stop()


def _run(df, name, tmp_path, mode="append"):
    _finish(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")))
    return df.sparkSession.table(name)


def test_debounce(spark, tmp_path):
    base = [("a", 0, "x"), ("a", 100, "y"), ("a", 500, "z"), ("b", 50, "q"), ("a", 900, "w"), ("zz", 10_000, "end")]
    df = spark.createDataFrame([(k, i, ms, t) for i, (k, ms, t) in enumerate(base)], "k string, id int, ms long, text string").withColumn("ts", F.timestamp_millis("ms"))
    out = _run(D.debounce_stream(_stream(spark, df, tmp_path, 1), ["k"], "ts", ["ms", "id"]), "debounced", tmp_path)
    assert sorted((r.k, r.text) for r in out.collect()) == [("a", "w"), ("a", "y"), ("a", "z"), ("b", "q")]


def test_debounce_clears_on_blank_text(spark, tmp_path):
    base = [("a", 0, "x"), ("a", 100, " "), ("b", 50, "q"), ("c", 60, ""), ("zz", 10_000, "end")]
    df = spark.createDataFrame([(k, i, ms, t) for i, (k, ms, t) in enumerate(base)], "k string, id int, ms long, text string").withColumn("ts", F.timestamp_millis("ms"))
    out = _run(D.debounce_stream(_stream(spark, df, tmp_path, 1), ["k"], "ts", ["ms", "id"], text_col="text"), "cleared", tmp_path)
    assert sorted((r.k, r.action) for r in out.collect()) == [("a", "CLEAR"), ("b", "FIRE"), ("c", "CLEAR")]


def test_repeats_are_dropped_across_triggers(spark, tmp_path):
    values = ["a", "a", "b", "b", "b", "a", "a", "c"]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, id int, v string")
    out = _run(D.drop_repeats_stream(_stream(spark, df, tmp_path), "k", "id", "v"), "repeats", tmp_path)
    assert [r.v for r in out.orderBy("id").collect()] == ["a", "b", "a", "c"]


def test_consecutive_repeats_of_numbers_and_nulls_across_triggers(spark, tmp_path):
    values = [7, 7, None, None, 8, 7, 7, 8]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, id int, v bigint")
    out = _run(D.drop_repeats_stream(_stream(spark, df, tmp_path), "k", "id", "v"), "numbers", tmp_path)
    assert [r.v for r in out.orderBy("id").collect()] == [7, None, 8, 7, 8]


def test_latest_frame(spark, tmp_path):
    df = spark.createDataFrame([("k", i, i * 10) for i in range(9)], "k string, id int, v int")
    out = _run(D.keep_latest_stream(_stream(spark, df, tmp_path), ["k"], ["id"]), "latest", tmp_path, "complete")
    assert [(r.id, r.v) for r in out.collect()] == [(8, 80)]


def test_segments_keep_their_state_between_triggers(spark, tmp_path):
    rng = random.Random(5)
    frames, loud = [], False
    while len(frames) < 900:
        frames += [loud] * rng.choice([1, 2, 5, 20, 36, 50])
        loud = not loud
    machine, want = SpeechSegmenter(), []
    for seq, f in enumerate(frames, 1):
        want += machine.push(seq, f, 320, seq * 20)
    rows = [("s", seq, f, 320, seq * 20) for seq, f in enumerate(frames, 1)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, speech boolean, n_samples int, time_ms long")
    out = _run(segments.utterances_stream(_stream(spark, df, tmp_path, 4, "seq"), idle_ms=None), "speech", tmp_path)
    got = [tuple(r)[1:] for r in out.orderBy("end_seq", F.desc("kind")).collect()]
    assert sorted(got) == sorted(want) and want


def test_history_and_chunk_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "hi", "hallo"), (1, " ", "x"), (2, "yo", "")], "id int, source_text string, translated_text string")
    _finish(sinks.history_sink(_stream(spark, df, tmp_path, 2), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [0]

    docs = spark.createDataFrame([("d1", "one two"), ("d2", "three")], "document_id string, text string")
    source = _stream(spark, docs, tmp_path / "c", 2, "document_id")
    _finish(sinks.chunk_sink(source, HashedBagOfWords(8), str(tmp_path / "chunks"), str(tmp_path / "cp2")))
    assert sorted((r.document_id, r.ordinal) for r in spark.read.parquet(str(tmp_path / "chunks")).collect()) == [("d1", 0), ("d2", 0)]


def test_observers_see_every_change(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "id int, k int")
    seen = []
    counts = _stream(spark, df, tmp_path).groupBy("k").count()
    _finish(sinks.observe(counts, lambda b, i: seen.append(sorted(map(tuple, b.collect()))), str(tmp_path / "cp")))
    assert seen[-1] == [(0, 3), (1, 3)] and len(seen) == 3


def test_live_turns(spark):
    df = spark.createDataFrame([(0, "Final", " hi "), (1, "Partial", "h"), (2, "Final", " ")], "id int, kind string, text string")
    rows = sinks.live_turns(df, F.upper, "en", "id", "P").collect()
    assert [(r.id, r.source_text, r.translated_text, r.target_language) for r in rows] == [(0, "hi", "HI", "id")]


def test_an_idle_stream_is_flushed(spark, tmp_path):
    import time

    rows = [("s", seq, True, 320, seq * 20) for seq in range(1, 41)]  # speech that never ends
    df = spark.createDataFrame(rows, "stream_id string, seq long, speech boolean, n_samples int, time_ms long")
    out = segments.utterances_stream(_stream(spark, df, tmp_path, 1, "seq"), idle_ms=500)
    q = out.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 40
        while not spark.table("idle").count() and time.time() < until:
            time.sleep(0.5)
        assert [tuple(r)[1:] for r in spark.table("idle").collect()] == [("FINAL", 1, 40, 40, 12_800, "END_OF_STREAM")]
    finally:
        q.stop()
