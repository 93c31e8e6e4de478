"""Document catalog, personas, translation history and folder ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T
from ragspark.functions import vectors as V
from ragspark.operators import catalog as C
from ragspark.operators import offsets as O
from ragspark.operators.chunking import chunk_text, first_and_last, rebase
from ragspark.operators.ordered import Ordering, with_index, with_place
from ragspark.operators.embedding import HashedBagOfWords
from ragspark.plans.ingestion import ingest, ingest_store
from ragspark.queries.registry import documents, plain, query, sql_chunks, table
from ragspark.sources.snapshots import feed, write_snapshot
from ragspark.sources.store import BucketStore
from ragspark.sources.tables import shared_path, written

DIM = 64

_LISTING = """listing AS (SELECT doc_id AS document_id, 'doc' || doc_id || CASE WHEN doc_id % 17 = 0 THEN '.bin' ELSE '.txt' END AS display_name,
  CASE WHEN doc_id % 31 = 0 THEN 300000000 ELSE n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END END AS size_bytes, lang AS mime_type, doc_id * 1000 AS modified_ms FROM documents WHERE doc_id % 10 <> 2
  UNION ALL SELECT doc_id + 10000000, 'new' || doc_id || '.PDF', n_chars, lang, 0 FROM documents WHERE doc_id % 10 = 3),
catalog AS (SELECT doc_id AS document_id, 'doc' || doc_id || CASE WHEN doc_id % 17 = 0 THEN '.bin' ELSE '.txt' END AS display_name, n_chars AS size_bytes, lang AS mime_type, doc_id * 1000 AS modified_ms, doc_id % 7 <> 5 AS indexed FROM documents)"""


def _catalog(spark, folder):
    ext = F.when(F.col("doc_id") % 17 == 0, ".bin").otherwise(".txt")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext).alias("display_name"),
        F.col("n_chars").alias("size_bytes"), F.col("lang").alias("mime_type"), (F.col("doc_id") * 1000).alias("modified_ms"),
        (F.col("doc_id") % 7 != 5).alias("indexed"),
    )


def _listing(spark, folder):
    i = F.col("document_id")
    seen = _catalog(spark, folder).drop("indexed").where(i % 10 != 2)
    size = F.when(i % 31 == 0, 300_000_000).otherwise(F.col("size_bytes") + F.when(i % 10 == 1, 1).otherwise(0))
    added = _catalog(spark, folder).where(i % 10 == 3).select(
        (i + 10_000_000).alias("document_id"), F.concat(F.lit("new"), i.cast("string"), F.lit(".PDF")).alias("display_name"),
        "size_bytes", "mime_type", F.lit(0).cast("bigint").alias("modified_ms"),
    )
    return seen.withColumn("size_bytes", size.cast("bigint")).unionByName(added)


@query("catalog_diff", f"""WITH {_LISTING} SELECT coalesce(l.document_id, c.document_id) AS document_id, CASE WHEN l.document_id IS NULL THEN 'ABSENT' WHEN l.size_bytes > {X.DOCUMENT_BYTES} OR lower(l.display_name) LIKE '%.bin' THEN 'REJECTED'
  WHEN c.document_id IS NULL THEN 'NEW' WHEN (l.display_name, l.size_bytes, l.mime_type, l.modified_ms) <> (c.display_name, c.size_bytes, c.mime_type, c.modified_ms) THEN 'CHANGED' WHEN NOT c.indexed THEN 'INCOMPLETE' ELSE 'UNCHANGED' END AS status,
  CASE WHEN l.size_bytes > {X.DOCUMENT_BYTES} THEN '{X.TOO_LARGE}' WHEN lower(l.display_name) LIKE '%.bin' THEN '{X.UNSUPPORTED_TYPE}' END AS reason
FROM listing l FULL JOIN catalog c ON l.document_id = c.document_id""")
def catalog_diff(spark, folder):
    return C.classify(_listing(spark, folder), _catalog(spark, folder))


_HEADER = "document_id, display_name, size_bytes, mime_type, modified_ms"


@query("catalog_feed", f"""WITH {_LISTING}, d AS (SELECT coalesce(l.document_id, c.document_id) AS document_id, c.size_bytes AS was, l.size_bytes AS now,
  CASE WHEN l.document_id IS NULL THEN 'REMOVED' WHEN c.document_id IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS change
  FROM listing l FULL JOIN catalog c ON l.document_id = c.document_id
  WHERE (l.display_name, l.size_bytes, l.mime_type, l.modified_ms) IS DISTINCT FROM (c.display_name, c.size_bytes, c.mime_type, c.modified_ms))
SELECT 1 AS version, document_id, change, was, now FROM d
UNION ALL SELECT 3, document_id, CASE change WHEN 'REMOVED' THEN 'ADDED' WHEN 'ADDED' THEN 'REMOVED' ELSE change END, now, was FROM d""")
def catalog_feed(spark, folder):
    """What observers of the catalog are told over four versions: the listing comes, comes again unchanged, and is taken back.

    The step without a change reads no part of either version.
    """
    columns = _HEADER.split(", ")
    headers, listed = _catalog(spark, folder).select(columns), _listing(spark, folder).select(columns)
    versions = [write_snapshot(rows, shared_path(spark, "catalog"), ["document_id"], parts=16) for rows in (headers, listed, listed, headers)]
    return feed(versions).select("version", "document_id", "change", F.col("before.size_bytes").alias("was"), F.col("after.size_bytes").alias("now"))


# chunks of all documents with every seventh embedding missing
_KNOCKED = f"{sql_chunks()}, k AS (SELECT doc_id AS document_id, ordinal, end_token, (doc_id * 31 + ordinal) % 7 <> 3 AS ok FROM chunks)"


def _chunks(spark, folder):
    rows = chunk_text(documents(spark, folder), "doc_id").withColumnRenamed("doc_id", "document_id")
    return rows.withColumn("ok", (F.col("document_id") * 31 + F.col("ordinal")) % 7 != 3)


@query("resume_points", f"""WITH {_KNOCKED}, b AS (SELECT document_id, min(ordinal) FILTER (NOT ok) AS first_incomplete FROM k GROUP BY document_id),
l AS (SELECT k.document_id, b.first_incomplete, max(ordinal) FILTER (first_incomplete IS NULL OR ordinal < first_incomplete) AS last, max(end_token) FILTER (first_incomplete IS NULL OR ordinal < first_incomplete) AS stop
  FROM k JOIN b USING (document_id) GROUP BY ALL)
SELECT document_id, first_incomplete, coalesce(last + 1, 0) AS next_ordinal, greatest(coalesce(stop - 50, 0), 0) AS resume_token FROM l""")
def resume_points(spark, folder):
    return plain(C.resume_points(_chunks(spark, folder), F.col("ok")))


@query("first_and_last_chunk", f"""WITH {_KNOCKED} SELECT document_id, min(ordinal) FILTER (NOT ok) AS first_incomplete, max(ordinal) FILTER (ok) AS last_complete, max(ordinal) AS last_ordinal FROM k GROUP BY document_id""")
def first_and_last_chunk(spark, folder):
    return plain(first_and_last(_chunks(spark, folder), "document_id", F.col("ok")))


@query("missing_chunks", f"WITH {_KNOCKED} SELECT document_id, ordinal, end_token FROM k WHERE NOT ok")
def missing_chunks(spark, folder):
    chunks = _chunks(spark, folder)
    return plain(C.missing_chunks(chunks.select("document_id", "ordinal", "end_token"), chunks, F.col("ok")))


@query("health_audit", f"""WITH {_KNOCKED}, f AS (SELECT document_id, bool_and(ok) AS h, max(ordinal) FILTER (ok) + 1 AS n, count(*) AS rows FROM k GROUP BY document_id)
SELECT document_id, h AS healthy, coalesce(n, 0) AS expected_count, rows = coalesce(n, 0) AS count_ok FROM f""")
def health_audit(spark, folder):
    chunks = _chunks(spark, folder)
    catalog = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return plain(C.health(catalog, chunks, F.col("ok")))


@query("chunk_rebase", f"""WITH {_KNOCKED} SELECT document_id, ordinal + 3 AS ordinal, end_token + 1386 AS end_token FROM k""")
def chunk_rebase(spark, folder):
    """Chunks of a resumed source moved behind three finished ones."""
    return plain(rebase(_chunks(spark, folder), 3).select("document_id", "ordinal", "end_token"))


@query("document_records", f"WITH {_LISTING} SELECT document_id, display_name, size_bytes, mime_type, indexed FROM catalog")
def document_records(spark, folder):
    return C.records(_catalog(spark, folder))


_FILES = """files AS (SELECT doc_id, source AS folder, 'file:/' || source || '/' || doc_id || '.txt' AS uri, 'file:/' || source || '/' || doc_id || '.txt|' || n_chars || '|' || doc_id * 10 AS token,
  CASE WHEN doc_id % 4 = 0 THEN 'SKIPPED' WHEN doc_id % 9 = 5 AND source <> 'src3' THEN 'FAILED' ELSE 'INDEXED' END AS outcome FROM documents)"""


def _files(spark, folder):
    i = F.col("doc_id")
    uri = F.concat(F.lit("file:/"), "source", F.lit("/"), i.cast("string"), F.lit(".txt"))
    outcome = F.when(i % 4 == 0, "SKIPPED").when((i % 9 == 5) & (F.col("source") != "src3"), "FAILED").otherwise("INDEXED")
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("folder"), uri.alias("uri"), "n_chars", (i * 10).alias("mtime"), outcome.alias("outcome"),
        T.file_token(uri, F.col("n_chars"), i * 10).alias("token"),
    )


@query("folder_skip", f"WITH {_FILES} SELECT doc_id, uri, token FROM files WHERE outcome <> 'SKIPPED'")
def folder_skip(spark, folder):
    files = _files(spark, folder)
    done = files.where("outcome = 'SKIPPED'").select("token")
    return C.skip_completed(files.drop("token"), done, "uri", "n_chars", "mtime").select("doc_id", "uri", "token")


@query("folder_summary", f"""WITH {_FILES}, s AS (SELECT folder, count(*) AS discovered, count(*) FILTER (outcome = 'INDEXED') AS indexed, count(*) FILTER (outcome = 'SKIPPED') AS skipped, count(*) FILTER (outcome = 'FAILED') AS failed FROM files GROUP BY folder)
SELECT *, indexed + skipped = discovered AS complete, 'Indexed ' || indexed || ' of ' || discovered || ' files' || CASE WHEN skipped > 0 THEN '; skipped ' || skipped ELSE '' END || CASE WHEN failed > 0 THEN '; failed ' || failed ELSE '' END AS message FROM s""")
def folder_summary(spark, folder):
    return C.folder_summary(_files(spark, folder), "folder")


@query("folder_failures", f"WITH {_FILES} SELECT folder, uri, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'doc' || doc_id END, uri) AS name, 'unreadable' AS reason FROM files WHERE outcome = 'FAILED'")
def folder_failures(spark, folder):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    files = _files(spark, folder).withColumn("name", name).withColumn("reason", F.lit("unreadable"))
    return C.folder_failures(files, "folder", "uri", "name", "reason")


@query("folder_checkpoint", f"""WITH {_FILES}, o AS (SELECT DISTINCT folder FROM files WHERE outcome = 'FAILED') SELECT folder, token FROM files JOIN o USING (folder) WHERE outcome <> 'FAILED'""")
def folder_checkpoint(spark, folder):
    files = _files(spark, folder)
    return C.checkpoint_tokens(files.where("outcome = 'SKIPPED'"), files, "folder")


@query("delete_documents", "SELECT doc_id AS document_id, lang FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def delete_documents(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    doomed = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return C.delete_documents(d, doomed)


@query("index_state", """SELECT d.doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE l.quality + 10 END AS chunk_count, CASE WHEN l.doc_id IS NULL THEN true ELSE l.toxic = 0 END AS indexed
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def index_state(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("chunk_count"), F.lit(True).alias("indexed"))
    states = table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") + 10).alias("chunk_count"), (F.col("toxic") == 0).alias("indexed"))
    return C.set_index_state(d, states).select("document_id", "chunk_count", "indexed")


@query("failed_documents", """SELECT d.doc_id AS document_id, CASE WHEN l.toxic = 1 THEN l.quality ELSE 5 END AS chunk_count, coalesce(l.toxic, 0) <> 1 AS indexed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def failed_documents(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.lit(5).alias("chunk_count"), F.lit(True).alias("indexed"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("chunk_count"), "toxic")
    return C.after_failure(d, labels.where("toxic = 1"), labels).select("document_id", "chunk_count", "indexed")


@query("documents_nocase", """SELECT p_partkey, p_name, row_number() OVER (ORDER BY translate(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p_partkey) AS place FROM part""")
def documents_nocase(spark, folder):
    """Caseless order over the parts, with each row's place."""
    key = T.nocase_key(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    rows = table(spark, folder, "part").select("p_partkey", "p_name", key.alias("k"))
    return with_place(rows, "k", "p_partkey").select("p_partkey", "p_name", "place")


@query("uri_listing", """SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) AS place FROM pages""")
def uri_listing(spark, folder):
    """All sources in the order of their URI strings, with each one's place."""
    return plain(with_place(table(spark, folder, "pages").select("page_id", "url"), "url", "page_id"))


@query("documents_by_name", "SELECT doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY lower(source), doc_id) AS position FROM documents")
def documents_by_name(spark, folder):
    """All documents in caseless name order, with their position within the language.

    A name that many documents share is split by id range, so no name is sorted in one task.
    """
    d = table(spark, folder, "documents").select("doc_id", "source", "lang", T.nocase_key(F.col("source")).alias("k"))
    d = d.withColumn("_bucket", F.struct("k", F.floor(F.col("doc_id") / 65_536).alias("range")))
    return plain(with_index(d, Ordering(("lang",), ("k", "doc_id")), "position").select("doc_id", "source", "position"))


# personas: customers, one owner per nation
_PERSONAS = """p AS (SELECT CAST(c_nationkey AS BIGINT) AS owner, c_custkey AS persona_id, c_name AS name, c_mktsegment AS system_prompt, c_custkey % 25 = c_nationkey AS active FROM customer)"""


def _personas(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("owner"), F.col("c_custkey").alias("persona_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("system_prompt"), (F.col("c_custkey") % 25 == F.col("c_nationkey")).alias("active"),
    )


@query("personas_ordered", f"WITH {_PERSONAS} SELECT owner, persona_id, row_number() OVER (PARTITION BY owner ORDER BY active DESC, lower(name), persona_id) AS position FROM p")
def personas_ordered(spark, folder):
    """All personas of an owner: the active ones first, then by caseless name; buckets are name prefixes."""
    p = _personas(spark, folder).withColumns({"rest": ~F.col("active"), "k": T.nocase_key(F.col("name"))})
    p = p.withColumn("_bucket", F.struct("rest", F.substring("k", 1, 14).alias("prefix")))
    return plain(with_index(p, Ordering(("owner",), ("rest", "k", "persona_id")), "position").select("owner", "persona_id", "position"))


@query("personas_left", f"WITH {_PERSONAS} SELECT owner, persona_id, name FROM p WHERE persona_id % 4 <> 1")
def personas_left(spark, folder):
    """The personas after a delete that names some of them and some unknown ones."""
    p = _personas(spark, folder)
    doomed = p.where("persona_id % 4 = 1").select("persona_id").unionByName(p.select((-1 - F.col("persona_id")).alias("persona_id")))
    return C.delete_documents(p, doomed, "persona_id").select("owner", "persona_id", "name")


@query("set_active", f"""WITH {_PERSONAS}, t AS (SELECT owner, CASE WHEN owner % 3 = 0 THEN -1 ELSE max(persona_id) END AS target FROM p GROUP BY owner)
SELECT owner, persona_id, CASE WHEN owner % 3 = 0 THEN active ELSE persona_id = target END AS active FROM p JOIN t USING (owner)""")
def set_active(spark, folder):
    p = _personas(spark, folder)
    target = p.groupBy("owner").agg(F.max("persona_id").alias("m")).select("owner", F.when(F.col("owner") % 3 == 0, -1).otherwise(F.col("m")).alias("persona_id"))
    return C.set_active(p, target, "owner").select("owner", "persona_id", "active")


@query("save_active", f"""WITH {_PERSONAS}, s AS (SELECT owner, min(persona_id) AS persona_id FROM p WHERE owner % 2 = 0 GROUP BY owner)
SELECT p.owner, p.persona_id, CASE WHEN s.owner IS NULL THEN p.active ELSE p.persona_id = s.persona_id END AS active, CASE WHEN p.persona_id = s.persona_id THEN 'Saved' ELSE p.name END AS name FROM p LEFT JOIN s ON p.owner = s.owner""")
def save_active(spark, folder):
    p = _personas(spark, folder)
    rows = p.where("owner % 2 = 0").groupBy("owner").agg(F.min("persona_id").alias("persona_id"), F.min_by("system_prompt", "persona_id").alias("system_prompt")).select(
        "owner", "persona_id", F.lit("Saved").alias("name"), "system_prompt", F.lit(False).alias("active")
    )
    return C.save_active(p, rows, "owner").select("owner", "persona_id", "active", "name")


@query("persona_delete", f"""SELECT o_orderkey, CASE WHEN o_custkey * 2 IN (SELECT c_custkey FROM customer) THEN 'DELETED' ELSE '{X.PERSONA_DELETE_MISSING}' END AS outcome FROM orders""")
def persona_delete(spark, folder):
    asked = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("persona_id"))
    return C.delete_outcome(_personas(spark, folder), asked).select("o_orderkey", "outcome")


@query("persona_upsert", f"""WITH {_PERSONAS}, o AS (SELECT o_custkey AS persona_id, max(o_orderkey) AS version FROM orders GROUP BY 1)
SELECT persona_id, coalesce('Order ' || o.version, name) AS name FROM p LEFT JOIN o USING (persona_id)
UNION ALL SELECT o.persona_id, 'Order ' || o.version FROM o WHERE o.persona_id NOT IN (SELECT persona_id FROM p)""")
def persona_upsert(spark, folder):
    """Personas replaced by the newest of their orders."""
    p = _personas(spark, folder).select("persona_id", "name", F.lit(-1).cast("bigint").alias("version"))
    new = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("persona_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("version")
    )
    return C.upsert(p, new, ["persona_id"], "version").select("persona_id", "name")


@query("persona_rules", f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '  ' WHEN turn % 2 = 0 THEN text ELSE role END AS name, CASE WHEN turn % 6 = 5 THEN ' ' ELSE repeat(text, CAST(1 + conv_id % 20 AS BIGINT)) END AS prompt,
  CAST(conv_id % 12 AS FLOAT) / CAST(10 AS FLOAT) AS temperature, CAST(4 + turn % 8 AS FLOAT) / CAST(10 AS FLOAT) AS top_p, (conv_id * 97 + turn * 401) % 5000 AS max_tokens FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(name) = '' THEN '{X.PERSONA_NAME_REQUIRED}' WHEN len(trim(name)) > 80 THEN '{X.PERSONA_NAME_LONG}' WHEN trim(prompt) = '' THEN '{X.PERSONA_PROMPT_REQUIRED}' WHEN len(trim(prompt)) > 20000 THEN '{X.PERSONA_PROMPT_LONG}'
  WHEN temperature NOT BETWEEN CAST(0.1 AS FLOAT) AND CAST(1.0 AS FLOAT) THEN '{X.PERSONA_TEMPERATURE}' WHEN top_p NOT BETWEEN CAST(0.5 AS FLOAT) AND CAST(1.0 AS FLOAT) THEN '{X.PERSONA_TOP_P}'
  WHEN max_tokens NOT BETWEEN 256 AND 4096 THEN '{X.PERSONA_MAX_TOKENS}' END AS error FROM c""")
def persona_rules(spark, folder):
    i, t = F.col("conv_id"), F.col("turn")
    ten = F.lit(10.0).cast("float")
    error = C.persona_error(
        F.when(t % 5 == 4, "  ").when(t % 2 == 0, F.col("text")).otherwise(F.col("role")),
        F.when(t % 6 == 5, " ").otherwise(F.repeat("text", (1 + i % 20).cast("int"))),
        ((i % 12).cast("float") / ten).cast("float"), ((4 + t % 8).cast("float") / ten).cast("float"), (i * 97 + t * 401) % 5000,
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", error.alias("error"))


@query("persona_copy", f"WITH {_PERSONAS} SELECT owner, persona_id + 1000000000 AS persona_id, name || ' copy' AS name, false AS active FROM p")
def persona_copy(spark, folder):
    return C.persona_copy(_personas(spark, folder), F.col("persona_id") + 1_000_000_000).select("owner", "persona_id", "name", "active")


@query("persona_templates", f"WITH {_PERSONAS} SELECT owner, md5(name) AS persona_id, name, persona_id % 2 = 3 AS active FROM p")
def persona_templates(spark, folder):
    return C.persona_from_template(_personas(spark, folder), F.md5("name")).select("owner", "persona_id", "name", "active")


@query("recent_history", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_history(spark, folder):
    """The newest orders, at most a hundred however many are asked for."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return C.recent_history(o, 500, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


_HISTORY = """h AS (SELECT conv_id, turn, text AS source_text, CASE WHEN turn % 3 = 0 THEN ' ' || chr(10) WHEN turn % 3 = 1 THEN repeat(text, CAST(conv_id % 60 AS BIGINT)) ELSE role END AS translated_text FROM conversations),
e AS (SELECT *, CASE WHEN regexp_replace(source_text, '\\s', '', 'g') = '' OR regexp_replace(translated_text, '\\s', '', 'g') = '' THEN 'EMPTY' WHEN len(source_text) > 20000 OR len(translated_text) > 20000 THEN 'LONG' END AS error FROM h)"""


def _history(spark, folder):
    t = F.col("turn") % 3
    translated = F.when(t == 0, " \n").when(t == 1, F.repeat("text", (F.col("conv_id") % 60).cast("int"))).otherwise(F.col("role"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("source_text"), translated.alias("translated_text"))


@query("history_guard", f"""WITH {_HISTORY} SELECT conv_id, turn, CASE error WHEN 'EMPTY' THEN '{X.EMPTY_TRANSLATION}' WHEN 'LONG' THEN '{X.LONG_TRANSLATION}' END AS error FROM e""")
def history_guard(spark, folder):
    return _history(spark, folder).select("conv_id", "turn", C.history_error(F.col("source_text"), F.col("translated_text")).alias("error"))


@query("history_append", f"""WITH {_HISTORY} SELECT conv_id, turn, 'old' AS translated_text FROM h UNION ALL SELECT conv_id, turn, translated_text FROM e WHERE error IS NULL""")
def history_append(spark, folder):
    rows = _history(spark, folder)
    return C.append_history(rows.withColumn("translated_text", F.lit("old")), rows).select("conv_id", "turn", "translated_text")


@query("schema_upgrade", "SELECT doc_id, CAST(0 AS BIGINT) AS modified_ms FROM documents")
def schema_upgrade(spark, folder):
    return C.upgrade(table(spark, folder, "documents").select("doc_id"), "documents", 1)


@query("schema_upgrade_steps", f"""WITH {sql_chunks(64, 16)} SELECT CAST(v AS BIGINT) AS from_version, d.doc_id, d.source, d.lang, d.n_chars, CAST(0 AS BIGINT) AS modified_ms,
  count(c.ordinal) AS n_chunks, count(CASE WHEN v >= 2 AND c.ordinal % 2 = 0 THEN 1 END) AS n_vectors
FROM (VALUES (1), (2), (3)) t(v) CROSS JOIN documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY ALL""")
def schema_upgrade_steps(spark, folder):
    """Documents and chunks as versions 1 to 3 stored them, each brought to the newest version; stored vectors stay."""
    docs = documents(spark, folder)
    chunks = chunk_text(docs, "doc_id", size=64, overlap=16).select("doc_id", "ordinal")
    vector = F.when(F.col("ordinal") % 2 == 0, F.array(F.lit(1.0).cast("float")))
    done = []
    for version in (1, 2, 3):
        stored = chunks if version == 1 else chunks.withColumn("embedding", vector)
        tables = C.upgrade_tables({"documents": docs.drop("text"), "document_chunks": stored}, version)
        counts = tables["document_chunks"].groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_vectors"))
        done.append(tables["documents"].join(counts, "doc_id", "left").select(
            F.lit(version).alias("from_version"), "doc_id", "source", "lang", "n_chars", "modified_ms",
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors")))
    return plain(done[0].unionByName(done[1]).unionByName(done[2]))


@query("active_persona", f"WITH {_PERSONAS} SELECT owner, arg_min(name, persona_id) AS name FROM p WHERE active GROUP BY owner")
def active_persona(spark, folder):
    return C.first_match(_personas(spark, folder), ["owner"], F.col("active"), ["persona_id"]).select("owner", "name")


@query("chunks_with_documents", f"""WITH {sql_chunks(64, 16)} SELECT l.doc_id, c.ordinal, d.source || '/doc' || d.doc_id AS document_name, c.end_token FROM labels l JOIN chunks c USING (doc_id) JOIN documents d USING (doc_id) WHERE l.toxic = 1""")
def chunks_with_documents(spark, folder):
    """Chunks and names of the documents labelled toxic."""
    d = documents(spark, folder)
    wanted = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    rows = chunk_text(d.join(wanted, "doc_id", "left_semi"), "doc_id", size=64, overlap=16)
    names = d.select("doc_id", F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string")).alias("document_name"))
    return plain(rows.join(names, "doc_id").select("doc_id", "ordinal", "document_name", "end_token"))


# one run over a mutated listing, from chunks with holes
_INGESTED = f"""WITH {_LISTING}, {sql_chunks()},
s AS (SELECT coalesce(l.document_id, c.document_id) AS document_id, CASE WHEN l.document_id IS NULL THEN 'ABSENT' WHEN l.size_bytes > {X.DOCUMENT_BYTES} OR lower(l.display_name) LIKE '%.bin' THEN 'REJECTED' WHEN c.document_id IS NULL THEN 'NEW'
  WHEN l.size_bytes <> c.size_bytes THEN 'CHANGED' WHEN NOT c.indexed OR NOT EXISTS (SELECT 1) OR coalesce(h.bad, 0) > 0 THEN 'INCOMPLETE' ELSE 'UNCHANGED' END AS status
  FROM listing l FULL JOIN catalog c ON l.document_id = c.document_id LEFT JOIN (SELECT doc_id, count(*) AS bad FROM chunks WHERE (doc_id * 31 + ordinal) % 7 = 3 GROUP BY doc_id) h ON h.doc_id = c.document_id),
kept AS (SELECT doc_id AS document_id, ordinal FROM chunks WHERE (doc_id * 31 + ordinal) % 7 <> 3 AND doc_id NOT IN (SELECT document_id FROM s WHERE status = 'CHANGED')),
todo AS (SELECT document_id FROM s WHERE status IN ('NEW', 'CHANGED', 'INCOMPLETE')),
fresh AS (SELECT doc_id AS document_id, ordinal FROM chunks WHERE doc_id IN (SELECT document_id FROM todo)
  UNION ALL SELECT doc_id + 10000000, ordinal FROM chunks WHERE doc_id + 10000000 IN (SELECT document_id FROM todo)),
final AS (SELECT * FROM kept UNION SELECT * FROM fresh)
SELECT s.document_id, s.status, CASE s.status WHEN 'UNCHANGED' THEN 'SKIPPED' WHEN 'REJECTED' THEN 'FAILED' WHEN 'ABSENT' THEN 'ABSENT' ELSE 'INDEXED' END AS outcome, count(f.ordinal) AS n_chunks FROM s LEFT JOIN final f USING (document_id) GROUP BY ALL"""


@query("incremental_ingest", _INGESTED)
def incremental_ingest(spark, folder):
    """One incremental run over a mutated listing, starting from chunks with holes."""
    embedder = HashedBagOfWords(DIM)
    vector = F.array_repeat(F.lit(0.125).cast("float"), DIM)  # what a stored vector is does not matter here
    stored = _chunks(spark, folder).withColumn("embedding", F.when(F.col("ok"), vector)).drop("ok")
    catalog = _catalog(spark, folder).withColumn("chunk_count", F.lit(0))
    texts = documents(spark, folder).select(F.col("doc_id").alias("document_id"), "text")
    texts = texts.unionByName(texts.where("document_id % 10 = 3").withColumn("document_id", F.col("document_id") + 10_000_000))
    done = ingest(_listing(spark, folder), texts.withColumn("error", F.lit(None).cast("string")), catalog, stored, embedder)
    counts = done.chunks.where(V.is_valid(F.col("embedding"), DIM)).groupBy("document_id").agg(F.count("*").alias("n"))
    return done.outcomes.join(counts, "document_id", "left").select(
        "document_id", "status", "outcome", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chunks")
    )


@query("store_ingest", _INGESTED)
def store_ingest(spark, folder):
    """The same run on a stored corpus: made here from the tables, then only buckets with open documents are rewritten."""
    embedder = HashedBagOfWords(DIM)
    store = BucketStore.create(spark, shared_path(spark, "store"), buckets=32)
    vector = F.array_repeat(F.lit(0.125).cast("float"), DIM)
    first = store.begin()
    texts = documents(spark, folder).select(F.col("doc_id").cast("string").alias("document_id"), "text", "doc_id")
    first.stage("chunks", _chunks(spark, folder).select(
        F.col("document_id").cast("string"), "ordinal", "text", "start_token", "end_token", F.when(F.col("ok"), vector).alias("embedding")))
    first.stage("offsets", O.token_offsets(texts))
    named = {"document_id": F.col("document_id").cast("string"), "source_uri": F.lit("")}
    headers = _catalog(spark, folder).withColumns({**named, "chunk_count": F.lit(0)})
    first.stage("catalog", headers.select(*store.read("catalog").columns))
    first.publish(range(store.buckets))

    listing = _listing(spark, folder).withColumns(named)
    added = texts.where("doc_id % 10 = 3").withColumn("document_id", (F.col("doc_id") + 10_000_000).cast("string"))
    found = texts.unionByName(added).select("document_id", "text", F.lit(None).cast("string").alias("error"))
    outcomes = ingest_store(store, listing, found, embedder, audit=True)
    counts = store.read("chunks").where(V.is_valid(F.col("embedding"), DIM)).groupBy("document_id").agg(F.count("*").alias("n"))
    return outcomes.join(counts, "document_id", "left").select(
        F.col("document_id").cast("bigint").alias("document_id"), "status", "outcome", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chunks"))


@query("fill_holes", f"""WITH {sql_chunks()} SELECT doc_id AS document_id, ordinal, text, start_token, end_token FROM chunks WHERE (doc_id * 31 + ordinal) % 7 = 3""")
def fill_holes(spark, folder):
    """Every seventh chunk is lost and cut again, each from the stretch that the stored offset index tells."""
    docs = documents(spark, folder).select(F.col("doc_id").alias("document_id"), "text")
    index = written(O.token_offsets(docs), "offsets")
    stored = O.expected_chunks(index).where((F.col("document_id") * 31 + F.col("ordinal")) % 7 != 3)
    return plain(O.fill_holes(docs, index, stored))
