"""Vector store, search, evidence contexts, citations and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import vectors as V
from ragspark.operators import chunking as K
from ragspark.operators import embedding as M
from ragspark.operators import evidence as E
from ragspark.operators import search as S
from ragspark.plans import retrieval as R
from ragspark.queries.registry import SQL_HITS, documents, plain, query, sql_chunks, sql_id_windows, sql_vectors, table, word_ids
from ragspark.sources import codecs
from ragspark.sources.tables import written

DIM = 64
EMBEDDER = M.HashedBagOfWords(DIM)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def _named_documents(spark, folder):
    return documents(spark, folder).select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string")).alias("document_name"), "text",
    )


def _questions(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _hits(spark, folder):
    return R.retrieve(_named_documents(spark, folder), _questions(spark, folder), EMBEDDER)


# every fourth vector is damaged in its own way
_DAMAGED = """SELECT vec_id, label, CASE vec_id % 4 WHEN 1 THEN embedding[1:63] WHEN 2 THEN list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN CAST('nan' AS FLOAT) ELSE x END)
  WHEN 3 THEN NULL ELSE embedding END AS embedding FROM embeddings"""


def _damaged(spark, folder):
    e, m = F.col("embedding"), F.col("vec_id") % 4
    nan = F.lit(float("nan")).cast("float")
    return _vectors(spark, folder).withColumn("embedding", (
        F.when(m == 1, F.slice(e, 1, 63)).when(m == 2, F.transform(e, lambda x: F.when(x > 0.2, nan).otherwise(x)))
        .when(m == 3, F.lit(None)).otherwise(e)
    ))


@query("vector_validity", f"""SELECT vec_id, coalesce(len(embedding) = 64, false) AS complete,
  coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0, false) AS valid FROM ({_DAMAGED})""")
def vector_validity(spark, folder):
    return _damaged(spark, folder).select(
        "vec_id", V.is_complete(F.col("embedding"), DIM).alias("complete"), V.is_valid(F.col("embedding"), DIM).alias("valid")
    )


@query("cosine_guards", f"""WITH d AS ({_DAMAGED}), p AS (
  SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS a, CAST(CASE WHEN e.vec_id % 8 = 4 THEN list_transform(e.embedding, lambda x: CAST(0 AS FLOAT)) ELSE d.embedding END AS DOUBLE[]) AS b
  FROM embeddings e JOIN d USING (vec_id))
SELECT vec_id, round(CASE WHEN vec_id % 8 = 4 OR b IS NULL OR len(b) <> 64 OR len(list_filter(b, lambda x: NOT isfinite(x))) > 0 THEN -1 ELSE list_cosine_similarity(a, b) END, 6) AS score FROM p""")
def cosine_guards(spark, folder):
    d = _damaged(spark, folder).select("vec_id", F.when(
        F.col("vec_id") % 8 == 4, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    ).otherwise(F.col("embedding")).alias("b"))
    rows = _vectors(spark, folder).join(d, "vec_id")
    return plain(rows.select("vec_id", V.cosine(F.col("embedding"), F.col("b")).alias("score")))


@query("vector_topk", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS FLOAT) AS score FROM embeddings, q)
SELECT vec_id, round(CAST(score AS DOUBLE), 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10""")
def vector_topk(spark, folder):
    vectors = _vectors(spark, folder)
    asked = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    return plain(S.search(vectors, asked, ["vec_id"], k=10))


_KNN = """s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS FLOAT) AS score
  FROM embeddings a CROSS JOIN embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)"""


def _knn(spark, folder, **options):
    vectors = _vectors(spark, folder)
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return S.search_batch(vectors, asked, ["vec_id"], ["query_id"], DIM, 5, **options)


@query("vector_knn_all", f"WITH {_KNN} SELECT query_id, vec_id, rank, round(CAST(score AS DOUBLE), 6) AS score FROM r")
def vector_knn_all(spark, folder):
    return plain(_knn(spark, folder))


@query("vector_knn_grid", f"WITH {_KNN} SELECT query_id, vec_id, rank, round(CAST(score AS DOUBLE), 6) AS score FROM r")
def vector_knn_grid(spark, folder):
    """The same search with the queries in several blocks, over pivot cells."""
    return plain(_knn(spark, folder, query_bytes=DIM * 8 * 128, pruned=True))


@query("vector_keyset_page", "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id > 100 AND len(embedding) = 64 ORDER BY vec_id LIMIT 256")
def vector_keyset_page(spark, folder):
    rows = S.page_after(_vectors(spark, folder), "vec_id", 100, 256, V.is_complete(F.col("embedding"), DIM))
    return plain(rows.select("vec_id", "label"))


@query("window_weighted_mean", """WITH u AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding) AS v, unnest(range(64)) AS dim FROM embeddings),
m AS (SELECT label, dim, sum(CAST(v AS DOUBLE) * w) / sum(w) AS v FROM u GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS label, dim, round(CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS FLOAT) AS DOUBLE), 6) AS value FROM m""")
def window_weighted_mean(spark, folder):
    means = M.weighted_mean(_vectors(spark, folder).withColumn("weight", F.col("vec_id") % 7 + 1), ["label"], DIM)
    return plain(means.select("label", F.posexplode("embedding").alias("dim", "value")))


@query("mean_pool", """WITH u AS (SELECT vec_id // 4 AS seq, unnest(embedding) AS v, unnest(range(64)) AS dim FROM embeddings WHERE vec_id % 4 <> 2)
SELECT seq, dim, round(CAST(CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS value FROM u GROUP BY ALL""")
def mean_pool(spark, folder):
    # four consecutive vectors are the positions of one sequence; the third is padding
    slot = F.col("vec_id") % 4
    item = F.struct(slot.alias("i"), F.col("embedding").alias("v"), F.when(slot == 2, 0).otherwise(1).alias("m"))
    rows = _vectors(spark, folder).groupBy(F.call_function("div", F.col("vec_id"), F.lit(4)).alias("seq")).agg(
        F.array_sort(F.collect_list(item)).alias("p")
    )
    pooled = M.mean_pool(F.transform("p", lambda x: x["v"]), F.transform("p", lambda x: x["m"]), DIM)
    return plain(rows.select("seq", F.posexplode(pooled).alias("dim", "value")))


@query("blob_roundtrip", """SELECT vec_id, CAST(CASE WHEN vec_id % 10 = 0 THEN 252 ELSE 256 END AS BIGINT) AS n_bytes,
  CASE WHEN vec_id % 10 <> 0 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 6) END AS total, CASE WHEN vec_id % 10 <> 0 THEN true END AS equal FROM embeddings""")
def blob_roundtrip(spark, folder):
    blob = codecs.to_blob(F.col("embedding"))
    rows = _vectors(spark, folder).withColumn("blob", blob)
    rows = rows.withColumn("blob", F.when(F.col("vec_id") % 10 == 0, F.substring("blob", 1, 252)).otherwise(F.col("blob")))
    rows = rows.withColumn("back", codecs.from_blob(F.col("blob"), DIM))
    return plain(rows.select(
        "vec_id", F.octet_length("blob").alias("n_bytes"),
        F.aggregate("back", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"),
        (F.col("back") == F.col("embedding")).alias("equal"),
    ))


# a small vector store: (label, vec_id) is the chunk key, updates touch every third, strays have no chunk
def _store(spark, folder):
    chunks = _vectors(spark, folder).select(
        F.col("label").alias("document_id"), F.col("vec_id").alias("ordinal"),
        F.when(F.col("vec_id") % 7 != 3, F.col("embedding")).alias("embedding"),
    )
    updates = _vectors(spark, folder).where("vec_id % 3 = 0").select(
        F.col("label").alias("document_id"), F.when(F.col("vec_id") % 6 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 1_000_000).alias("ordinal"),
        F.transform("embedding", lambda x: -x).alias("embedding"),
    )
    return chunks, updates


_STORE = """chunks AS (SELECT label AS document_id, vec_id AS ordinal, CASE WHEN vec_id % 7 <> 3 THEN embedding END AS embedding FROM embeddings),
updates AS (SELECT label AS document_id, CASE WHEN vec_id % 6 = 0 THEN vec_id ELSE vec_id + 1000000 END AS ordinal, list_transform(embedding, lambda x: -x) AS embedding FROM embeddings WHERE vec_id % 3 = 0)"""
_KEYS = ["document_id", "ordinal"]


@query("vector_upsert", f"""WITH {_STORE} SELECT CAST(c.document_id AS BIGINT) AS document_id, c.ordinal, round(CAST(coalesce(u.embedding, c.embedding)[1] AS DOUBLE), 6) AS first_value
FROM chunks c LEFT JOIN updates u USING (document_id, ordinal)""")
def vector_upsert(spark, folder):
    chunks, updates = _store(spark, folder)
    return plain(S.upsert_vectors(chunks, updates, _KEYS).select(*_KEYS, F.col("embedding")[0].alias("first_value")))


@query("rejected_updates", f"""WITH {_STORE} SELECT CAST(u.document_id AS BIGINT) AS document_id, u.ordinal, CASE WHEN u.ordinal % 5 < 2 THEN 'INVALID_VECTOR' ELSE 'UNKNOWN_CHUNK' END AS reason
FROM updates u LEFT JOIN chunks c USING (document_id, ordinal) WHERE u.ordinal % 5 < 2 OR c.ordinal IS NULL""")
def rejected_updates(spark, folder):
    """Updates of which some are too short, some hold NaN and some have no chunk."""
    chunks, updates = _store(spark, folder)
    e, m = F.col("embedding"), F.col("ordinal") % 5
    nan = F.lit(float("nan")).cast("float")
    spoilt = F.when(m == 0, F.slice(e, 1, 63)).when(m == 1, F.concat(F.slice(e, 1, 63), F.array(nan))).otherwise(e)
    return plain(S.rejected_updates(chunks, updates.withColumn("embedding", spoilt), _KEYS, DIM).drop("embedding"))


@query("orphan_vectors", f"WITH {_STORE} SELECT CAST(u.document_id AS BIGINT) AS document_id, u.ordinal FROM updates u ANTI JOIN chunks c USING (document_id, ordinal)")
def orphan_vectors(spark, folder):
    chunks, updates = _store(spark, folder)
    return plain(S.orphans(updates, chunks, _KEYS).select(*_KEYS))


@query("reconcile_vectors", f"""WITH {_STORE} SELECT CAST(document_id AS BIGINT) AS document_id, ordinal, round(CAST(coalesce(c.embedding, u.embedding)[1] AS DOUBLE), 6) AS first_value
FROM chunks c LEFT JOIN updates u USING (document_id, ordinal) WHERE c.embedding IS NOT NULL OR u.embedding IS NOT NULL""")
def reconcile_vectors(spark, folder):
    chunks, updates = _store(spark, folder)
    return plain(S.reconcile(updates, chunks, _KEYS, DIM).select(*_KEYS, F.col("embedding")[0].alias("first_value")))


@query("delete_tail", """SELECT CAST(label AS BIGINT) AS document_id, vec_id AS ordinal FROM embeddings
WHERE label % 3 = 2 OR (label % 3 = 1 AND vec_id < label * 20)""")
def delete_tail(spark, folder):
    chunks, _ = _store(spark, folder)
    targets = chunks.select("document_id").distinct().where("document_id % 3 < 2").withColumn(
        "from_ordinal", F.when(F.col("document_id") % 3 == 0, 0).otherwise(F.col("document_id") * 20)
    )
    return plain(S.delete_tail(chunks, targets, "document_id").select(*_KEYS))


@query("embed_chunks", f"""WITH {sql_chunks()}, {sql_vectors('cv', 'chunks', 'doc_id, ordinal')}
SELECT doc_id AS document_id, ordinal, count(*) AS n_buckets, round(max(v), 6) AS top_value, round(sum(v), 6) AS total FROM cv GROUP BY ALL""")
def embed_chunks(spark, folder):
    """Chunk vectors from the stand-in embedder."""
    rows = R.embed_chunks(_named_documents(spark, folder), EMBEDDER)
    return plain(rows.select("document_id", "ordinal", *_summary()))


@query("embed_windows", f"""WITH {sql_chunks()}, {sql_id_windows()},
b AS (SELECT doc_id, ordinal, window_no, len(part) + 2 AS weight, id % 64 AS bucket, count(*) AS n
  FROM (SELECT *, unnest(list_concat([101, 102], part)) AS id FROM w) GROUP BY ALL),
u AS (SELECT *, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, ordinal, window_no)) AS FLOAT) AS DOUBLE) AS v FROM b),
m AS (SELECT doc_id, ordinal, bucket, sum(v * weight) AS s FROM u GROUP BY ALL),
x AS (SELECT doc_id, ordinal, CAST(CAST(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id, ordinal)) AS FLOAT) AS DOUBLE) AS v FROM m)
SELECT doc_id AS document_id, ordinal, count(*) AS n_buckets, round(max(v), 6) AS top_value, round(sum(v), 6) AS total FROM x GROUP BY ALL""")
def embed_windows(spark, folder):
    """Chunk vectors the long way: ids, framed windows, a vector each, mean by active tokens."""
    chunks = K.chunk_text(documents(spark, folder), "doc_id").select(
        F.col("doc_id").alias("document_id"), "ordinal", word_ids(F.col("text")).alias("ids")
    )
    rows = M.embed_windows(chunks, ["document_id", "ordinal"], "ids", M.HashedIds(DIM), 101, 102, 0, 64)
    return plain(rows.select("document_id", "ordinal", *_summary()))


def _summary():
    return [
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_buckets"), F.array_max("embedding").alias("top_value"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"),
    ]


@query("hydrate_ranked", f"""WITH {SQL_HITS}
SELECT h.item_id AS question_id, h.rank, h.doc_id AS document_id, h.ordinal, d.source || '/doc' || h.doc_id AS document_name,
  round(CAST(h.score AS DOUBLE), 6) AS score, md5(c.text) AS text_md5
FROM hits h JOIN chunks c USING (doc_id, ordinal) JOIN documents d USING (doc_id)""")
def hydrate_ranked(spark, folder):
    return plain(_hits(spark, folder).select(
        "question_id", "rank", "document_id", "ordinal", "document_name", "score", F.md5("text").alias("text_md5")
    ))


# scores lowered by the question, with some NaN, so that hits pass, miss and tie
_SHIFTED = f"""{SQL_HITS}, shifted AS (
  SELECT item_id, doc_id, ordinal, rank, CASE WHEN (item_id + rank) % 7 = 0 THEN CAST('nan' AS FLOAT)
    WHEN rank % 2 = 0 THEN CAST(0.35 AS FLOAT) ELSE CAST(score - (item_id % 5) * 0.2 AS FLOAT) END AS score FROM hits),
rel AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS position FROM shifted
  WHERE NOT isnan(score) AND score >= CAST(0.35 AS FLOAT) QUALIFY position <= 3)"""


def _shifted(spark, folder):
    nan = F.lit(float("nan")).cast("float")
    return _hits(spark, folder).withColumn("score", (
        F.when((F.col("question_id") + F.col("rank")) % 7 == 0, nan).when(F.col("rank") % 2 == 0, F.lit(0.35).cast("float"))
        .otherwise((F.col("score").cast("double") - (F.col("question_id") % 5) * F.lit(0.2)).cast("float"))
    ))


@query("relevance_filter", f"""WITH {_SHIFTED} SELECT item_id AS question_id, position, doc_id AS document_id, ordinal, round(CAST(score AS DOUBLE), 6) AS score FROM rel""")
def relevance_filter(spark, folder):
    rows = E.relevant(_shifted(spark, folder), ["question_id"], limit=3)
    return plain(rows.select("question_id", "position", "document_id", "ordinal", "score"))


def _sql_context(hits: str, limit: int, budget: str) -> str:
    return f"""{hits}, items AS (
  SELECT r.item_id, r.position, '[local:' || r.doc_id || ':' || r.ordinal || '] ' || d.source || '/doc' || r.doc_id || '#' || r.ordinal || chr(10) AS header, c.text
  FROM rel r JOIN chunks c USING (doc_id, ordinal) JOIN documents d USING (doc_id) WHERE r.position <= {limit}),
bounds AS (SELECT item_id, {budget} AS cap, max(position) AS last FROM items GROUP BY item_id),
fold AS (
  WITH RECURSIVE f AS (
    SELECT item_id, cap, last, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS used, CAST('' AS VARCHAR) AS body, CAST(0 AS BIGINT) AS n FROM bounds
    UNION ALL
    SELECT item_id, cap, last, position, CASE WHEN ok THEN used + sep + len(header) + len(part) ELSE used END,
      CASE WHEN ok THEN body || CASE WHEN n > 0 THEN chr(10) || chr(10) ELSE '' END || header || part ELSE body END, CASE WHEN ok THEN n + 1 ELSE n END
    FROM (SELECT *, room > 0 AND part <> '' AS ok FROM (
      SELECT f.item_id, f.cap, f.last, i.position, f.used, f.body, f.n, i.header, CASE WHEN f.n > 0 THEN 2 ELSE 0 END AS sep,
        f.cap - f.used - CASE WHEN f.n > 0 THEN 2 ELSE 0 END - len(i.header) AS room,
        substr(i.text, 1, greatest(0, f.cap - f.used - CASE WHEN f.n > 0 THEN 2 ELSE 0 END - len(i.header))) AS part
      FROM f JOIN items i ON i.item_id = f.item_id AND i.position = f.position + 1)))
  SELECT item_id, used, body, n FROM f WHERE position = last)"""


_BASE_REL = f"""{SQL_HITS}, rel AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS position FROM hits
  WHERE NOT isnan(score) AND score >= CAST(0.35 AS FLOAT))"""


@query("answer_contexts", f"""WITH {_sql_context(_BASE_REL, 5, '9000')}
SELECT b.item_id AS question_id, CASE WHEN f.item_id IS NULL THEN 'NO_EVIDENCE' WHEN f.n = 0 THEN 'BUDGET_EXCEEDED' ELSE 'OK' END AS status,
  f.used AS used_chars, CASE WHEN f.n > 0 THEN f.body END AS context FROM benchmark b LEFT JOIN fold f USING (item_id)""")
def answer_contexts(spark, folder):
    """Every benchmark text asked as a question over the whole corpus."""
    rows = R.answer_contexts(_named_documents(spark, folder), _questions(spark, folder), EMBEDDER)
    return plain(rows.select("question_id", "status", "used_chars", "context"))


@query("stored_search", f"""WITH {SQL_HITS}
SELECT item_id AS question_id, rank, doc_id AS document_id, ordinal, round(CAST(score AS DOUBLE), 6) AS score, md5(c.text) AS text_md5
FROM hits JOIN chunks c USING (doc_id, ordinal)""")
def stored_search(spark, folder):
    """Questions over a stored chunk table: vectors are read, not made again."""
    docs = _named_documents(spark, folder)
    chunks = written(R.embed_chunks(docs, EMBEDDER), "chunks")
    rows = R.retrieve(docs, _questions(spark, folder), EMBEDDER, chunks=chunks)
    return plain(rows.select("question_id", "rank", "document_id", "ordinal", "score", F.md5("text").alias("text_md5")))


@query("rag_status", f"""WITH {_sql_context(_SHIFTED, 3, 'CASE WHEN item_id % 3 = 0 THEN 20 WHEN item_id % 3 = 1 THEN 700 ELSE 4000 END')}
SELECT b.item_id AS question_id, CASE WHEN f.item_id IS NULL THEN 'NO_EVIDENCE' WHEN f.n = 0 THEN 'BUDGET_EXCEEDED' ELSE 'OK' END AS status,
  coalesce(f.n, 0) AS n_parts, CASE WHEN f.n > 0 THEN f.body END AS context FROM benchmark b LEFT JOIN fold f USING (item_id)""")
def rag_status(spark, folder):
    """Three budgets over the shifted scores: contexts, budget failures and retrieval misses."""
    m = F.col("question_id") % 3
    hits = _shifted(spark, folder).withColumn("cap", F.when(m == 0, 20).when(m == 1, 700).otherwise(4000))
    contexts = E.build_context(hits, ["question_id"], limit=3, max_chars="cap")
    rows = E.with_status(_questions(spark, folder), contexts, ["question_id"])
    return plain(rows.select(
        "question_id", "status", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_parts"), "context"
    ).withColumn("n_parts", F.greatest(F.col("n_parts"), F.lit(0))))


@query("evidence_citations", f"""WITH {SQL_HITS}
SELECT item_id AS question_id, rank, source || '/doc' || h.doc_id || ' · chunk ' || (ordinal + 1) AS title,
  'local:' || h.doc_id || ':' || ordinal AS source_id, 'Local document · ' || printf('%.2f', round(CAST(score AS DOUBLE), 2)) AS label
FROM hits h JOIN documents d USING (doc_id)""")
def evidence_citations(spark, folder):
    from ragspark.functions.text import provider_label
    c = E.local_citation(F.col("document_id"), F.col("document_name"), F.col("ordinal"), F.col("text"), F.col("score"))
    rows = _hits(spark, folder).withColumn("c", c)
    return plain(rows.select(
        "question_id", "rank", F.col("c.title").alias("title"), F.col("c.source_id").alias("source_id"),
        provider_label(F.col("c.provider"), F.round(F.col("c.score").cast("double"), 2)).alias("label"),
    ))


# answers: a valid marker, an unknown one, none, repeats, a blank id, no citations at all
@query("bind_citations", r"""WITH a AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'See [local:' || conv_id || ':0] and [local:' || conv_id || ':0].'
  WHEN 1 THEN 'See [local:' || conv_id || ':1], [web:9].' WHEN 2 THEN 'Nothing cited.' ELSE '[local:' || conv_id || ':2][local:' || conv_id || ':0] ' || text END AS answer,
  CASE WHEN conv_id % 5 = 4 THEN 0 WHEN conv_id % 5 = 3 THEN 1 ELSE 2 END AS shape FROM conversations),
r AS (SELECT *, list_distinct(regexp_extract_all(answer, '\[([A-Za-z0-9_:-]+)\]', 1)) AS refs,
  ['local:' || conv_id || ':0', 'local:' || conv_id || ':1', 'local:' || conv_id || ':2'] AS ids FROM a)
SELECT conv_id, turn, len(refs) AS n_refs, status, CASE WHEN status = 'BOUND' THEN array_to_string(list_filter(ids, lambda x: list_contains(refs, x)), ' ') ELSE '' END AS kept
FROM (SELECT *, CASE WHEN shape = 0 THEN 'PASS' WHEN shape = 1 THEN 'NO_STABLE_IDS' WHEN len(refs) = 0 THEN 'NO_CITATION'
  WHEN NOT list_has_all(ids, refs) THEN 'UNKNOWN_CITATION' ELSE 'BOUND' END AS status FROM r)""")
def bind_citations(spark, folder):
    conv = F.col("conv_id").cast("string")
    ids = [F.concat(F.lit("local:"), conv, F.lit(f":{i}")) for i in range(3)]
    mark = [F.concat(F.lit("["), i, F.lit("]")) for i in ids]
    answer = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("See "), mark[0], F.lit(" and "), mark[0], F.lit(".")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("See "), mark[1], F.lit(", [web:9].")))
        .when(F.col("turn") % 4 == 2, F.lit("Nothing cited.")).otherwise(F.concat(mark[2], mark[0], F.lit(" "), F.col("text")))
    )
    m = F.col("conv_id") % 5
    cites = F.array(*[F.struct(F.when(m == 3, " ").otherwise(i).alias("source_id")) for i in ids])
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", answer.alias("answer"), F.when(m == 4, F.slice(cites, 1, 0)).otherwise(cites).alias("cites")
    )
    bound = rows.withColumn("b", E.bind_citations(F.col("answer"), F.col("cites")))
    return plain(bound.select(
        "conv_id", "turn", F.size(E.referenced_ids(F.col("answer"))).alias("n_refs"), F.col("b.status").alias("status"),
        F.array_join(F.transform("b.kept", lambda c: c["source_id"]), " ").alias("kept"),
    ))


@query("route_evidence", f"""WITH r AS (SELECT conv_id, turn, conv_id % 2 = 0 AS use_rag, turn % 2 = 0 AS allow_web,
  CASE conv_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NO_EVIDENCE' ELSE 'BUDGET_EXCEEDED' END AS status, turn % 3 AS web_hits,
  CASE WHEN turn % 5 = 4 THEN 'Web search could not be completed' END AS web_error FROM conversations)
SELECT conv_id, turn, route, route IN ('WEB') OR (route = 'FAILED' AND coalesce(failure, '') NOT LIKE 'Local RAG%') AS web_called, failure FROM (
SELECT conv_id, turn, CASE WHEN use_rag AND status = 'OK' THEN 'LOCAL' WHEN use_rag AND status = 'BUDGET_EXCEEDED' THEN 'FAILED'
  WHEN use_rag AND NOT allow_web THEN 'WITHHELD' WHEN allow_web AND web_error IS NOT NULL THEN 'FAILED' WHEN allow_web AND web_hits > 0 THEN 'WEB'
  WHEN allow_web THEN 'FAILED' ELSE 'NO_CONTEXT' END AS route,
 CASE WHEN use_rag AND status = 'OK' THEN NULL WHEN use_rag AND status = 'BUDGET_EXCEEDED' THEN '{X.CONTEXT_FAILED_PREFIX}{X.BUDGET_EXCEEDED}'
  WHEN use_rag AND NOT allow_web THEN '{X.WITHHELD}' WHEN allow_web AND web_error IS NOT NULL THEN web_error WHEN allow_web AND web_hits > 0 THEN NULL
  WHEN allow_web AND use_rag THEN '{X.NO_WEB_AFTER_MISS}' WHEN allow_web THEN '{X.NO_WEB}' END AS failure FROM r)""")
def route_evidence(spark, folder):
    m = F.col("conv_id") % 3
    status = F.when(m == 0, "OK").when(m == 1, "NO_EVIDENCE").otherwise("BUDGET_EXCEEDED")
    route = E.route(
        F.col("conv_id") % 2 == 0, F.col("turn") % 2 == 0, status, F.col("turn") % 3,
        F.when(F.col("turn") % 5 == 4, "Web search could not be completed"),
    )
    rows = table(spark, folder, "conversations").withColumn("r", route)
    return rows.select("conv_id", "turn", F.col("r.route").alias("route"), F.col("r.web_called").alias("web_called"), F.col("r.failure").alias("failure"))


_EVENTS = """ev AS (SELECT conv_id, turn, seq, type, value FROM (
  SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS seq, 'Token' AS type, unnest(w) || ' ' AS value FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
  UNION ALL SELECT conv_id, turn, 1000000, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Completed' ELSE 'Failed' END, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Done: ' || text ELSE 'stopped' END
  FROM conversations WHERE (conv_id + turn) % 3 < 2))"""


def _answer_events(spark, folder):
    c = table(spark, folder, "conversations")
    tokens = c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "w")).select(
        "conv_id", "turn", (F.col("p") + 1).cast("bigint").alias("seq"), F.lit("Token").alias("type"), F.concat("w", F.lit(" ")).alias("value")
    )
    m = (F.col("conv_id") + F.col("turn")) % 3
    ends = c.where(m < 2).select(
        "conv_id", "turn", F.lit(1_000_000).cast("bigint").alias("seq"), F.when(m == 0, "Completed").otherwise("Failed").alias("type"),
        F.when(m == 0, F.concat(F.lit("Done: "), "text")).otherwise("stopped").alias("value"),
    )
    return tokens.unionByName(ends)


@query("stream_fold_answer", f"""WITH {_EVENTS} SELECT conv_id, turn, state, n_tokens, CASE state WHEN 'COMPLETED' THEN final WHEN 'DRAFT' THEN draft END AS text FROM (
 SELECT conv_id, turn, CASE max(type) FILTER (type <> 'Token') WHEN 'Completed' THEN 'COMPLETED' WHEN 'Failed' THEN 'REMOVED' ELSE 'DRAFT' END AS state,
  count(*) FILTER (type = 'Token') AS n_tokens, string_agg(value, '' ORDER BY seq) FILTER (type = 'Token') AS draft, max(value) FILTER (type = 'Completed') AS final FROM ev GROUP BY ALL)""")
def stream_fold_answer(spark, folder):
    return plain(E.fold_answers(_answer_events(spark, folder), ["conv_id", "turn"]))


@query("terminal_failures", f"""WITH {_EVENTS} SELECT conv_id, turn, max(seq) + 1 AS seq, 'Failed' AS type, '{X.ENDED_EARLY}' AS value FROM ev GROUP BY conv_id, turn
HAVING NOT bool_or(type IN ('Completed', 'Failed'))""")
def terminal_failures(spark, folder):
    return plain(E.terminal_failures(_answer_events(spark, folder), ["conv_id", "turn"]))


@query("route_questions", f"""WITH {SQL_HITS}, web AS (SELECT item_id, string_agg('[web:' || p || '] Page ' || page_id || chr(10) || 'URL: ' || url || chr(10) || '{X.UNTRUSTED_MARKER}' || chr(10) || html, chr(10) || chr(10) ORDER BY p) AS body
  FROM (SELECT item_id, page_id, url, html, row_number() OVER (PARTITION BY item_id ORDER BY page_id) AS p FROM benchmark JOIN pages ON page_id % 40 = item_id) WHERE p <= 3 GROUP BY item_id),
best AS (SELECT item_id, max(score) AS s FROM hits GROUP BY item_id)
SELECT b.item_id AS question_id, CASE WHEN best.s >= CAST(0.95 AS FLOAT) THEN 'LOCAL' WHEN b.item_id % 2 = 1 THEN 'WITHHELD' WHEN web.body IS NOT NULL THEN 'WEB' ELSE 'FAILED' END AS route,
  CASE WHEN best.s < CAST(0.95 AS FLOAT) AND b.item_id % 2 = 0 THEN web.body END AS web_context
FROM benchmark b JOIN best USING (item_id) LEFT JOIN web USING (item_id)""")
def route_questions(spark, folder):
    """Questions whose best score is under 0.95 are misses; even ones may use the web (pages)."""
    contexts = R.answer_contexts(_named_documents(spark, folder), _questions(spark, folder), EMBEDDER, minimum=0.95)
    from ragspark.operators.web import top_results
    # every page answers one question at most
    pages = table(spark, folder, "pages").withColumn("question_id", F.col("page_id") % 40)
    asked = _questions(spark, folder).select("question_id")
    web = top_results(pages.join(asked, "question_id", "left_semi"), ["question_id"], ["page_id"]).select(
        "question_id", "position", F.lit("").alias("source_id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        "url", F.col("html").alias("content"),
    )
    requests = _questions(spark, folder).select("question_id", F.lit(True).alias("use_rag"), (F.col("question_id") % 2 == 0).alias("allow_web"))
    rows = R.route_questions(contexts, web, requests)
    return rows.select("question_id", "route", F.when(F.col("route") == "WEB", F.col("context")).alias("web_context"))
