"""File sources, codecs and incremental ingestion."""

from __future__ import annotations

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ragspark import schemas
from ragspark.operators.embedding import HashedBagOfWords
from ragspark.plans.ingestion import ingest
from ragspark.session import shared_dir
from ragspark.sources import codecs, files, tables

XML = '<w:document xmlns:w="x"><w:t>Hel</w:t><w:t>lo wor</w:t><w:p>ld</w:p> tail</w:document>'


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.TXT").write_text("plain textü", encoding="utf8")
    (tmp_path / "deep" / "b.txt").write_text("x" * 50)
    (tmp_path / "deep" / "skip.bin").write_bytes(b"\0")
    (tmp_path / "deep" / "er" / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "deep" / "er" / "c.docx", "w") as z:
        z.writestr("other.xml", "<x>ignored</x>")
        z.writestr("word/document.xml", XML)
    return str(tmp_path)


def test_listing_is_recursive_and_filtered(spark, corpus):
    names = [r.display_name for r in files.list_files(spark, corpus).orderBy("source_uri").collect()]
    assert sorted(names) == ["a.TXT", "b.txt", "broken.docx", "c.docx", "p.pdf"]


def test_listing_does_not_read_content(spark, corpus):
    plan = files.list_files(spark, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_size_limit_is_inclusive_and_pushed_down(spark, corpus):
    kept = files.read_contents(spark, corpus, 50)
    assert "b.txt" in " ".join(r.source_uri for r in kept.collect())
    assert "b.txt" not in " ".join(r.source_uri for r in files.read_contents(spark, corpus, 49).collect())
    assert "LessThanOrEqual(length,50)" in kept._jdf.queryExecution().executedPlan().toString()


def test_text_of_each_format(spark, corpus):
    listing = files.list_files(spark, corpus)
    texts = files.extract_text(listing, files.read_contents(spark, corpus))
    got = {r.display_name: (r.text, r.error) for r in texts.join(listing, "document_id").collect()}
    assert got["a.TXT"] == ("plain textü", None)
    assert got["c.docx"][0].split() == ["Hel", "lo", "wor", "ld", "tail"]  # runs never merge
    assert got["p.pdf"] == (None, "PDF reader is not available")
    assert got["broken.docx"][0] is None and got["broken.docx"][1]
    read = files.extract_text(listing, files.read_contents(spark, corpus), lambda content: iter(["page", "two"]))
    assert "page\ntwo" in [r.text for r in read.collect()]


def test_digests(spark, corpus):
    rows = {r.source_uri.rsplit("/", 1)[1]: r.sha256 for r in files.file_digests(files.read_contents(spark, corpus)).collect()}
    assert rows["b.txt"] == hashlib.sha256(b"x" * 50).hexdigest()


def test_manifest(spark, tmp_path):
    item = {"id": "m", "displayName": "M", "url": "https://x/y", "revision": "r", "sizeBytes": 5, "sha256": "0" * 64, "license": "MIT", "abi": ["any"], "storageKind": "SAF_PERSISTENT"}

    def read(body):
        path = tmp_path / f"{abs(hash(json.dumps(body)))}.json"
        path.write_text(json.dumps(body, indent=1))
        return codecs.read_manifest(spark, str(path)).collect()

    rows = read({"schemaVersion": 1, "artifacts": [item, {**item, "id": "n", "format": "gguf"}]})
    assert [(r.id, r.format, r.mime_type) for r in rows] == [("m", "binary", "application/octet-stream"), ("n", "gguf", "application/octet-stream")]
    for bad, why in (({"schemaVersion": 2, "artifacts": [item]}, "version"), ({"schemaVersion": 1, "artifacts": [item, item]}, "duplicate"),
                     ({"schemaVersion": 1, "artifacts": [{**item, "extra": 1}]}, "unknown key")):
        with pytest.raises(Exception, match=why):
            read(bad)


def test_vocabulary_keeps_the_last_duplicate(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n[CLS]\na\na\n")
    assert codecs.read_vocabulary(spark, str(tmp_path / "v.txt")) == {"[PAD]": 0, "[CLS]": 1, "a": 3}


def test_document_lookup_reads_one_bucket(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("t").alias("text"))
    tables.write_by_document(rows, str(tmp_path / "chunks"), buckets=16)
    one = tables.read_document(spark, str(tmp_path / "chunks"), 42, buckets=16)
    assert [r.document_id for r in one.collect()] == [42]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(document_id,42)" in plan


def test_shared_dir(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def _listing(spark, rows):
    data = [(d, f"file:/{d}", f"{d}.txt", len(t), "text/plain", m) for d, t, m in rows]
    texts = spark.createDataFrame([(d, t, None) for d, t, _ in rows], "document_id string, text string, error string")
    return spark.createDataFrame(data, schemas.FILES), texts


def _state(done):
    return sorted(map(tuple, done.chunks.select("document_id", "ordinal", "text").collect())), {
        r.document_id: (r.chunk_count, r.indexed) for r in done.catalog.collect()
    }, {r.document_id: r.outcome for r in done.outcomes.collect()}


def test_ingestion_is_incremental_and_repeatable(spark):
    embedder = HashedBagOfWords(8)
    catalog, chunks = spark.createDataFrame([], schemas.DOCUMENTS), spark.createDataFrame([], schemas.CHUNKS)
    listing, texts = _listing(spark, [("a", "one two", 1), ("b", "three " * 600, 1), ("e", "", 1)])
    first = ingest(listing, texts, catalog, chunks, embedder)
    rows, headers, outcome = _state(first)
    assert headers == {"a": (1, True), "b": (2, True), "e": (0, True)} and set(outcome.values()) == {"INDEXED"}

    catalog = spark.createDataFrame(first.catalog.collect(), first.catalog.schema)
    chunks = spark.createDataFrame(first.chunks.collect(), first.chunks.schema)
    again = ingest(listing, texts, catalog, chunks, embedder)
    assert _state(again)[0] == rows and _state(again)[1] == headers and set(_state(again)[2].values()) == {"SKIPPED"}

    # a hole in the middle is filled, a changed file is cut again, a failed one loses its flag
    holed = chunks.withColumn("embedding", F.when(~((F.col("document_id") == "b") & (F.col("ordinal") == 0)), F.col("embedding")))
    listing, texts = _listing(spark, [("a", "uno", 2), ("b", "three " * 600, 1), ("e", "", 1), ("f", "x", 1)])
    texts = texts.withColumn("error", F.when(F.col("document_id") == "f", "unreadable"))
    rows2, headers2, outcome2 = _state(ingest(listing, texts, catalog, holed, embedder))
    assert [r for r in rows2 if r[0] == "a"] == [("a", 0, "uno")]
    assert [r[:2] for r in rows2 if r[0] == "b"] == [("b", 0), ("b", 1)]
    assert headers2["f"] == (0, False) and headers2["b"] == (2, True)
    assert outcome2 == {"a": "INDEXED", "b": "INDEXED", "e": "SKIPPED", "f": "FAILED"}


def test_every_listed_file_gets_a_row(spark):
    """Bad bytes are replaced; a file without content is an error, not a gap."""
    from ragspark.functions import fixed as X

    listed = spark.createDataFrame(
        [("a", "u1", "a.txt", "", 4), ("b", "u2", "b.txt", "", X.DOCUMENT_BYTES + 1), ("c", "u3", "c.txt", "", 5)],
        "document_id string, source_uri string, display_name string, mime_type string, size_bytes bigint")
    contents = spark.createDataFrame([("u1", bytearray(b"caf\xe9"))], "source_uri string, content binary")
    rows = {r.document_id: (r.text, r.error) for r in files.extract_text(listed, contents).collect()}
    assert rows == {"a": ("caf\ufffd", None), "b": (None, X.DOCUMENT_TOO_LARGE), "c": (None, files.UNREADABLE)}


def test_documents_without_text_are_not_indexed(spark):
    from ragspark.operators.embedding import HashedBagOfWords
    from ragspark.plans.ingestion import NO_TEXT, ingest

    listed = "document_id string, source_uri string, display_name string, mime_type string, size_bytes bigint, modified_ms bigint"
    listing = spark.createDataFrame([(x, x, f"{x}.txt", "", 5, 1) for x in ("a", "b", "c")], listed)
    catalog = spark.createDataFrame([], listed + ", chunk_count int, indexed boolean")
    chunks = spark.createDataFrame([], "document_id string, ordinal int, text string, start_token int, end_token int, embedding array<float>")
    texts = spark.createDataFrame([("a", "some words", None), ("c", None, None)], "document_id string, text string, error string")
    done = ingest(listing, texts, catalog, chunks, HashedBagOfWords(8))
    assert {r.document_id: (r.outcome, r.reason) for r in done.outcomes.collect()} == {
        "a": ("INDEXED", None), "b": ("FAILED", NO_TEXT), "c": ("FAILED", NO_TEXT)}
    assert {r.document_id: r.indexed for r in done.catalog.collect()} == {"a": True, "b": False, "c": False}


def test_oversize_bodies_are_reported(spark):
    from ragspark.functions import fixed as X
    from ragspark.operators import web

    bodies = spark.createDataFrame([(1, '{"web":{"results":[{"title":"t","url":"u","description":"d"}]}}'), (2, "x" * 600_000)], "id int, body string")
    assert {r.id: (r.title, r.error) for r in web.parse_search(bodies, "body", ["id"]).collect()} == {
        1: ("t", None), 2: (None, X.WEB_BODY_TOO_LARGE)}
    assert [r.error for r in web.parse_encyclopedia(bodies, "body", ["id"]).collect()] == [X.WEB_BODY_TOO_LARGE]
