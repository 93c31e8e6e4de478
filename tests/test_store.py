"""Sampled token offsets and the bucketed store."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ragspark import schemas
from ragspark.operators import offsets as O
from ragspark.operators.catalog import upgrade_tables
from ragspark.operators.chunking import chunk_text
from ragspark.operators.embedding import HashedBagOfWords
from ragspark.plans.ingestion import ingest, ingest_store
from ragspark.sources.store import BucketStore, Run


def _texts():
    rng = random.Random(3)
    spaces = [" ", "\n", " ", "  ", "\t \x1c"]
    def text(n):
        return "".join(rng.choice(spaces) + rng.choice(["a", "wörd", "漢字", "😀x", "longer-token-of-some-size"]) for _ in range(n))
    return [
        ("none", None), ("empty", ""), ("blank", " \n "), ("one", "x"), ("exact", " ".join("ab" for _ in range(24))),
        ("tail", text(30) + "  \n"), ("long", text(4000)), ("run", "y" * 1000), ("mid", text(57)),
    ]


def _set(df):
    return {tuple(r) for r in df.select("document_id", "ordinal", "text", "start_token", "end_token").collect()}


@pytest.mark.parametrize("every", [1, 7, 12, 64])
def test_chunks_cut_from_their_stretch_equal_chunks_of_the_whole_text(spark, every):
    docs = spark.createDataFrame(_texts(), "document_id string, text string").withColumn("skip", F.lit(1)).withColumn("block", F.lit(2))
    whole = chunk_text(docs, size=12, overlap=4, max_token_length=9)
    index = O.token_offsets(docs, every=every, max_token_length=9)
    stored = whole.where("pmod(ordinal, 3) <> 1")
    filled = O.fill_holes(docs, index, stored, size=12, overlap=4, every=every, max_token_length=9)
    assert _set(filled) == _set(whole.where("pmod(ordinal, 3) = 1"))
    assert _set(O.fill_holes(docs, index, whole.limit(0), size=12, overlap=4, every=every, max_token_length=9)) == _set(whole)
    assert O.fill_holes(docs, index, whole, size=12, overlap=4, every=every, max_token_length=9).isEmpty()


def test_offsets_are_the_bytes_where_blocks_begin(spark):
    texts = dict(_texts())
    docs = spark.createDataFrame(_texts(), "document_id string, text string")
    rows = O.token_offsets(docs, every=7).collect()
    assert {r.document_id for r in rows} == {"one", "exact", "tail", "long", "run", "mid"}
    for r in rows:
        data = texts[r.document_id].encode()[r["at"] : r["at"] + r["n_bytes"]]
        assert len(data.decode().split()) == r["n_tokens"] and r["n_tokens"] <= 7
        if r["block"]:
            assert len(texts[r.document_id].encode()[: r["at"]].decode().split()) == 7 * r["block"]


def test_a_hole_reads_only_the_blocks_it_touches(spark):
    docs = spark.createDataFrame(_texts(), "document_id string, text string")
    index = O.token_offsets(docs, every=64)
    wanted = O.expected_chunks(index, size=48, overlap=8).where("document_id = 'long' and ordinal in (0, 50)")
    read = O.stretches(wanted, index, every=64).agg(F.sum("n_bytes")).first()[0]
    assert 0 < read < 0.1 * len(dict(_texts())["long"].encode())
    with pytest.raises(ValueError):
        O.token_offsets(docs, every=0)


def test_a_text_that_changed_is_not_cut_by_its_old_index(spark):
    old = spark.createDataFrame([("a", "one two three"), ("b", "four five")], "document_id string, text string")
    new = spark.createDataFrame([("a", "one two"), ("b", "four five"), ("c", "six")], "document_id string, text string")
    index = O.token_offsets(old, every=2)
    assert [r.document_id for r in O.indexed(new, index).collect()] == ["b"]
    none = spark.createDataFrame([], "document_id string, ordinal int")
    assert _set(O.fill_holes(new, index, none, every=2)) == {("b", 0, "four five", 0, 2)}


def _listed(spark, rows):
    data = [(d, f"file:/{d}", f"{d}.txt", len(t or ""), "text/plain", m) for d, t, m in rows]
    texts = spark.createDataFrame([(d, t, None) for d, t, _ in rows], "document_id string, text string, error string")
    return spark.createDataFrame(data, schemas.FILES), texts


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


CHUNK = ("document_id", "ordinal", "text", "start_token", "end_token", "embedding")


def test_store_ingestion_equals_ingestion_and_rewrites_only_open_buckets(spark, tmp_path):
    embedder = HashedBagOfWords(8)
    store = BucketStore.create(spark, str(tmp_path / "store"), buckets=8)
    docs = [(f"d{i}", f"word{i} " * (100 * i), 1) for i in range(12)] + [("null", None, 1), ("empty", "", 1)]
    catalog, chunks = store.read("catalog"), store.read("chunks")
    assert catalog.isEmpty() and chunks.isEmpty()

    def both(rows, audit=False):
        """The run on the store against the plain one over the rows the store held before."""
        held = [spark.createDataFrame(store.read(t).collect(), store.tables[t]) for t in ("catalog", "chunks")]
        listing, texts = _listed(spark, rows)
        plain = ingest(listing, texts, *held, embedder)
        done = ingest_store(store, listing, texts, embedder, audit)
        assert _rows(done, *done.columns) == _rows(plain.outcomes, *done.columns)
        assert _rows(store.read("chunks"), *CHUNK) == _rows(plain.chunks, *CHUNK)
        assert _rows(store.read("catalog"), *held[0].columns) == _rows(plain.catalog, *held[0].columns)
        return {r.document_id: r.outcome for r in done.collect()}

    assert both(docs) == {**{d: "INDEXED" for d, _, _ in docs}, "null": "FAILED"}
    before = store.versions()
    docs = [r for r in docs if r[0] != "null"]
    assert set(both([*docs, ("null", "", 1)]).values()) == {"SKIPPED", "INDEXED"}  # only the failed one is tried again

    # one changed document: one bucket of each table is new, the others keep their files
    changed = [("d3", "other " * 700, 2) if d == "d3" else (d, t, m) for d, t, m in docs]
    before = store.versions()
    both([*changed, ("null", "", 1)])
    after = store.versions()
    bucket = store.buckets_of(spark.createDataFrame([("d3",)], "document_id string"))
    assert {k for k in after if after[k] != before[k]} == {(t, b) for t in store.tables for b in bucket}
    assert all(f"/bucket={bucket[0]}/" in f for f in store.read("chunks", bucket).inputFiles())

    # a chunk without a vector is found by the audit and comes back by its offsets
    held = spark.createDataFrame(store.read("chunks").collect(), schemas.CHUNKS)
    lost = store.begin()
    lost.stage("chunks", held.withColumn("embedding", F.when((F.col("document_id") != "d11") | (F.col("ordinal") != 1), F.col("embedding"))))
    lost.publish(range(8))
    assert both([*changed, ("null", "", 1)], audit=True)["d11"] == "INDEXED"
    assert _rows(store.read("chunks"), *CHUNK) == _rows(held, *CHUNK)

    # nothing open: nothing written
    before = store.versions()
    assert set(both([*changed, ("null", "", 1)]).values()) == {"SKIPPED"} and store.versions() == before


def test_a_run_that_dies_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    embedder = HashedBagOfWords(8)
    store = BucketStore.create(spark, str(tmp_path / "store"), buckets=4)
    listing, texts = _listed(spark, [("a", "one two", 1), ("b", "three " * 600, 1)])

    def dies(self, buckets):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Run, "publish", dies)
        with pytest.raises(RuntimeError):
            ingest_store(store, listing, texts, embedder)
    assert all(BucketStore(spark, store.root).read(t).isEmpty() for t in store.tables)
    ingest_store(store, listing, texts, embedder)
    again = BucketStore(spark, store.root)
    assert again.buckets == 4 and _rows(again.read("chunks"), "document_id", "ordinal") == [("a", 0), ("b", 0), ("b", 1)]


def test_rows_outside_the_replaced_buckets_are_refused(spark, tmp_path):
    store = BucketStore.create(spark, str(tmp_path / "store"), buckets=4, tables={"t": "document_id string, n int"})
    rows = spark.createDataFrame([(str(i), i) for i in range(20)], "document_id string, n int")
    run = store.begin()
    run.stage("t", rows)
    with pytest.raises(ValueError):
        run.publish([0, 1])
    run.publish(range(4))
    assert store.read("t").count() == 20 and store.read("t", [9]).isEmpty()
    empty = store.begin()
    empty.stage("t", rows.limit(0))
    empty.publish([2])
    assert store.read("t", [2]).isEmpty() and store.read("t").count() == rows.where(store.bucket() != 2).count()


def test_every_step_of_the_schema_is_taken_once(spark):
    documents, chunks = spark.createDataFrame([("a",)], "document_id string"), spark.createDataFrame([("a", 0)], "document_id string, ordinal int")
    columns = lambda tables: {name: df.columns for name, df in tables.items()}
    old = {"documents": documents, "document_chunks": chunks}
    assert columns(upgrade_tables(old, 1, 2)) == {"documents": ["document_id"], "document_chunks": ["document_id", "ordinal", "embedding"]}
    assert set(upgrade_tables(old, 2, 3)) == {*old, "translation_history"}
    done = upgrade_tables(old, 1)
    assert done["documents"].collect() == [("a", 0)] and done["document_chunks"].collect() == [("a", 0, None)]
    assert done["translation_history"].isEmpty() and columns(upgrade_tables(done, 1)) == columns(done)
    assert upgrade_tables({**old, "translation_history": chunks}, 1)["translation_history"] is chunks


def test_the_index_runs_its_pattern_once(spark):
    from pyspark.sql import functions as F

    from ragspark.operators import offsets as O

    docs = spark.createDataFrame([(1, "a b  c d e"), (2, ""), (3, None), (4, " \t")], "document_id int, text string")
    index = O.token_offsets(docs, every=2)
    assert [tuple(r)[:5] for r in index.orderBy("block").collect()] == [(1, 0, 0, 3, 2), (1, 1, 3, 5, 2), (1, 2, 8, 2, 1)]
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text#") == 1  # the other counts the words of the last block
