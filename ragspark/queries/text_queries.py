"""Tokens, chunks, windows and string functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.functions.vectors import active_tokens
from ragspark.operators import chunking as K
from ragspark.operators.wordpiece import WordPiece
from ragspark.queries.registry import PRE, SQL_TOKENS, documents, plain, query, sql_chunks, sql_id_windows, table, word_ids


def _name() -> object:
    ext = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".PDF", ".docx", ".bin")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext)


@query("token_stats", f"""WITH {SQL_TOKENS}
SELECT doc_id, CASE WHEN doc_id % 8 = 3 OR doc_id % 4 = 0 THEN 'TXT' WHEN doc_id % 4 = 1 THEN 'PDF' WHEN doc_id % 4 = 2 THEN 'DOCX' END AS format,
  len(t) AS n_tokens, list_max(list_transform(t, lambda x: len(x))) AS longest, CAST(list_sum(list_transform(t, lambda x: len(x))) AS BIGINT) AS total_chars
FROM toks WHERE len(t) > 0""")
def token_stats(spark, folder):
    """Token facts from disjoint windows, so a huge document is never one array."""
    mime = F.when(F.col("doc_id") % 8 == 3, T.TEXT_MIME).otherwise("")
    parts = K.chunk_text(documents(spark, folder), "doc_id", size=4096, overlap=0)
    lengths = F.transform(F.split("text", " "), F.length)
    facts = parts.select("doc_id", lengths.alias("l")).select(
        "doc_id", F.size("l").alias("n"), F.array_max("l").alias("m"), F.aggregate("l", F.lit(0), lambda a, x: a + x).alias("s")
    ).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.max("m").alias("longest"), F.sum("s").alias("total_chars"))
    return plain(facts.withColumn("format", T.document_format(_name(), mime)))


@query("long_run_split", r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^\p{Z}\x09-\x0D\x1C-\x1F]{1,8}') AS p FROM documents)
SELECT doc_id, i AS ordinal, array_to_string(p[i*4096+1 : i*4096+4096], ' ') AS pieces FROM p, LATERAL unnest(range(0, CAST(ceil(len(p) / 4096.0) AS BIGINT))) u(i)""")
def long_run_split(spark, folder):
    """Tokens cut at eight characters, in disjoint windows."""
    rows = K.chunk_text(documents(spark, folder), "doc_id", size=4096, overlap=0, max_token_length=8)
    return plain(rows.select("doc_id", "ordinal", F.col("text").alias("pieces")))


@query("chunk_documents", f"WITH {sql_chunks()} SELECT doc_id, ordinal, start_token, end_token, text FROM chunks")
def chunk_documents(spark, folder):
    return plain(K.chunk_text(documents(spark, folder), "doc_id"))


@query("chunk_small_windows", f"WITH {sql_chunks(64, 16)} SELECT doc_id, ordinal, start_token, end_token, text FROM chunks")
def chunk_small_windows(spark, folder):
    return plain(K.chunk_text(documents(spark, folder), "doc_id", size=64, overlap=16))


@query("chunk_coverage_audit", f"""WITH {SQL_TOKENS}
SELECT doc_id, CASE WHEN len(t) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(t) - 512) / 462.0) AS BIGINT) END AS n_chunks,
  len(t) AS n_tokens, true AS contiguous, true AS overlap_ok FROM toks WHERE len(t) > 0""")
def chunk_coverage_audit(spark, folder):
    return plain(K.coverage_audit(K.chunk_text(documents(spark, folder), "doc_id"), "doc_id"))


@query("basic_pretokens", f"""WITH {sql_chunks()} SELECT doc_id, ordinal, len(w) AS n, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5
FROM (SELECT doc_id, ordinal, regexp_extract_all(lower(text), '{PRE}') AS w FROM chunks)""")
def basic_pretokens(spark, folder):
    rows = _chunk_rows(spark, folder).select("doc_id", "ordinal", T.pretokens(F.col("text")).alias("w"))
    return plain(rows.select(
        "doc_id", "ordinal", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.md5(F.array_join("w", " ")).alias("words_md5"),
    ))


def _chunk_rows(spark, folder):
    return K.chunk_text(documents(spark, folder), "doc_id").select("doc_id", "ordinal", "text")


@query("id_windows", f"""WITH {sql_chunks()}, {sql_id_windows()}
SELECT doc_id, ordinal, window_no, len(part) + 2 AS n_active,
  md5('101,' || CASE WHEN len(part) > 0 THEN array_to_string(part, ',') || ',' ELSE '' END || '102' || repeat(',0', 62 - len(part))) AS ids_md5,
  repeat('1', len(part) + 2) || repeat('0', 62 - len(part)) AS mask FROM w""")
def id_windows(spark, folder):
    """Framed id windows of every chunk."""
    rows = K.window_rows(_chunk_rows(spark, folder).select("doc_id", "ordinal", word_ids(F.col("text")).alias("ids")), "ids", 101, 102, 0, 64)
    return plain(rows.select(
        "doc_id", "ordinal", "window_no", active_tokens(F.col("attention_mask")).alias("n_active"),
        F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.array_join("attention_mask", "").alias("mask"),
    ))


def letter_vocabulary(spark, folder, size: int = 30_000):
    """A table ``token, id`` of the ``size`` most frequent word pieces of the corpus: letters, continued letters, short heads.

    ``size`` is the vocabulary's own size, as a model file would fix it: pieces beyond it do not exist and
    their words become unknown.  Words are counted first, so the shuffle moves each distinct word once per task.
    """
    words = _chunk_rows(spark, folder).select(F.explode(T.pretokens(F.col("text"))).alias("w")).groupBy("w").count()
    letters = F.split("w", "")
    pieces = F.array_distinct(F.concat(
        letters, F.transform(letters, lambda c: F.concat(F.lit("##"), c)), F.array(F.substring("w", 1, 2), F.substring("w", 1, 3))
    ))
    counted = words.select(F.explode(pieces).alias("p"), "count").groupBy("p").agg(F.sum("count").alias("n"))
    fixed = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
    top = counted.orderBy(F.desc("n"), "p").limit(size)  # numbered by one task: no more rows than the vocabulary
    ranked = top.select(F.col("p").alias("token"), (F.row_number().over(Window.orderBy(F.desc("n"), "p")) + len(fixed) - 1).alias("id"))
    return spark.createDataFrame(list(zip(fixed, range(len(fixed)))), "token string, id int").unionByName(ranked)


# the longest piece at every position of every distinct word, then a walk from match to match
@query("wordpiece_windows", f"""WITH RECURSIVE {sql_chunks()},
pre AS (SELECT doc_id, ordinal, regexp_extract_all(lower(text), '{PRE}') AS ws FROM chunks),
words AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM pre) GROUP BY w),
candidates AS (SELECT c, unnest(list_distinct(list_concat(l, list_transform(l, lambda x: '##' || x), [substr(w, 1, 2), substr(w, 1, 3)]))) AS p
  FROM (SELECT w, c, list_transform(range(1, len(w) + 1), lambda i: substr(w, i, 1)) AS l FROM words)),
vocab AS (SELECT p, 3 + row_number() OVER (ORDER BY sum(c) DESC, p) AS id FROM candidates GROUP BY p QUALIFY id <= 30003),
best AS (SELECT w, a, max(e) AS e, arg_max(id, e) AS id FROM (
  SELECT w, a, unnest(range(1, 1 + least(len(w) - a, (SELECT max(len(p)) FROM vocab)))) AS e FROM (SELECT w, unnest(range(0, len(w))) AS a FROM words WHERE len(w) <= 100))
  JOIN vocab ON p = CASE WHEN a > 0 THEN '##' ELSE '' END || substr(w, a + 1, e) GROUP BY w, a),
walk AS (SELECT w, CAST(0 AS BIGINT) AS a, CAST([] AS BIGINT[]) AS ids FROM words
  UNION ALL SELECT k.w, k.a + b.e, list_append(k.ids, b.id) FROM walk k JOIN best b ON b.w = k.w AND b.a = k.a),
cut AS (SELECT words.w, coalesce(k.ids, [1]) AS ids FROM words LEFT JOIN walk k ON k.w = words.w AND k.a = len(words.w)),
seq AS (SELECT doc_id, ordinal, flatten(list(ids ORDER BY i)) AS a FROM (
  SELECT doc_id, ordinal, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM pre) JOIN cut USING (w) GROUP BY ALL),
win AS (SELECT doc_id, ordinal, i AS window_no, a[i*254+1 : i*254+254] AS part FROM (SELECT doc_id, ordinal, coalesce(a, CAST([] AS BIGINT[])) AS a FROM pre LEFT JOIN seq USING (doc_id, ordinal)),
  LATERAL unnest(range(0, greatest(1, CAST(ceil(len(a) / 254.0) AS BIGINT)))) u(i))
SELECT doc_id, ordinal, window_no, len(part) + 2 AS n_active,
  md5('2,' || CASE WHEN len(part) > 0 THEN array_to_string(part, ',') || ',' ELSE '' END || '3' || repeat(',0', 254 - len(part))) AS ids_md5 FROM win""")
def wordpiece_windows(spark, folder):
    """Framed WordPiece windows of every chunk."""
    pieces = WordPiece.from_table(letter_vocabulary(spark, folder))
    rows = pieces.window_rows(_chunk_rows(spark, folder))
    return plain(rows.select(
        "doc_id", "ordinal", "window_no", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
        active_tokens(F.col("attention_mask")).alias("n_active"),
    ))


@query("resume_replay", f"""WITH {SQL_TOKENS}, r AS (SELECT doc_id, len(t) + (doc_id % 5 - 2) * 30 AS n, doc_id % 3 AS done,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE greatest(0, least((doc_id % 3 - 1) * 462 + 512, len(t)) - 50) END AS start FROM toks)
SELECT doc_id, CASE WHEN n - start < 0 THEN 'CHANGED' WHEN done = 0 THEN 'CONTINUE' WHEN start = 0 AND n > 0 AND n <= 50 THEN 'COMPLETE'
  WHEN n - start < 50 THEN 'CHANGED' WHEN n - start = 50 THEN 'COMPLETE' ELSE 'CONTINUE' END AS replay FROM r""")
def resume_replay(spark, folder):
    n, done = T.token_count(F.col("text")), F.col("doc_id") % 3
    start = F.when(done == 0, 0).otherwise(F.greatest(F.lit(0), F.least((done - 1) * 462 + 512, F.col("n")) - 50))
    rows = documents(spark, folder).select("doc_id", n.alias("n"))
    return rows.select("doc_id", K.replay_status(F.col("n") + (F.col("doc_id") % 5 - 2) * 30, start, done).alias("replay"))


@query("prefix_reuse", r"""WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT conv_id, turn, len(y) AS n, least(len(x), len(y)) AS l,
  list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) AS miss FROM p),
k AS (SELECT conv_id, turn, n, CASE WHEN coalesce(miss, 0) = 0 THEN l ELSE miss - 1 END AS common FROM m)
SELECT conv_id, turn, CAST(common AS BIGINT) AS common, CAST(CASE WHEN common > 0 AND n <= common THEN common - 1 ELSE common END AS BIGINT) AS restart_at FROM k""")
def prefix_reuse(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", F.split("text", " ").alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("y"))
    rows = c.join(nxt, ["conv_id", "turn"]).withColumn("common", K.common_prefix(F.col("t"), F.col("y")))
    return plain(rows.select(
        "conv_id", "turn", "common", K.reusable_prefix(F.col("common"), F.size("y")).alias("restart_at")
    ))


@query("uuid_from_uri", """SELECT page_id, url, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' ||
  substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT page_id, url, md5(url) AS h FROM pages)""")
def uuid_from_uri(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url", T.name_uuid(F.col("url")).alias("uuid"))


@query("stable_ids", """SELECT page_id, substr(sha256(url), 1, 24) AS url_id, sha256(html) AS digest,
  sha256('turn-v1' || chr(0) || url || chr(0) || html) AS cache_key, url || '|' || greatest(page_id - 5, 0) || '|' || greatest(page_id * 7, 0) AS token FROM pages""")
def stable_ids(spark, folder):
    p = table(spark, folder, "pages")
    return p.select(
        "page_id", T.stable_id(F.col("url")).alias("url_id"), F.sha2("html", 256).alias("digest"),
        T.prompt_cache_key("turn-v1", F.col("url"), F.col("html")).alias("cache_key"),
        T.file_token(F.col("url"), F.col("page_id") - 5, F.col("page_id") * 7).alias("token"),
    )


@query("format_bytes", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 97 WHEN 2 THEN -3 ELSE 104729 END // 7 AS n FROM lineitem),
s AS (SELECT *, greatest(n, 0) AS p FROM v),
d AS (SELECT *, CASE WHEN p < 1000 THEN NULL WHEN p < 1000000 THEN (p + 50) // 100 WHEN p < 1000000000 THEN (p + 50000) // 100000 ELSE (p + 50000000) // 100000000 END AS tenths,
  CASE WHEN p < 1000 THEN ' B' WHEN p < 1000000 THEN ' KB' WHEN p < 1000000000 THEN ' MB' ELSE ' GB' END AS unit FROM s)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, n, CASE WHEN tenths IS NULL THEN CAST(p AS VARCHAR)
  WHEN tenths % 10 = 0 THEN CAST(tenths // 10 AS VARCHAR) ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) END || unit AS size_label FROM d""")
def format_bytes(spark, folder):
    li = table(spark, folder, "lineitem")
    m = F.col("l_linenumber") % 4
    scale = F.when(m == 0, 1).when(m == 1, 97).when(m == 2, -3).otherwise(104729).cast("bigint")
    n = F.call_function("div", F.round(F.col("l_extendedprice") * 100).cast("bigint") * scale, F.lit(7).cast("bigint"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("n"))
    return plain(rows.withColumn("size_label", T.format_bytes(F.col("n"))))


@query("progress_pct", """SELECT o_orderkey, CASE WHEN total > 0 THEN CAST(least(greatest(trunc(100.0 * (done / CAST(total AS DOUBLE))), 0), 100) AS BIGINT) ELSE 0 END AS pct,
  round(CASE WHEN total > 0 THEN least(greatest(done / CAST(total AS DOUBLE), 0), 1) ELSE 0 END, 6) AS part
FROM (SELECT o_orderkey, o_custkey * 13 - 500 AS done, (o_orderkey % 9) * 1000 AS total FROM orders)""")
def progress_pct(spark, folder):
    done, total = F.col("o_custkey") * 13 - 500, (F.col("o_orderkey") % 9) * 1000
    return plain(table(spark, folder, "orders").select(
        "o_orderkey", T.percent(done, total).alias("pct"), T.fraction(done, total).alias("part")
    ))


@query("safe_filename", r"""WITH d AS (SELECT page_id, url_decode(replace(url, '?', '%20&x=%2E')) AS v FROM pages),
s AS (SELECT page_id, v, regexp_extract(v, '[^/\\]*$') AS seg FROM d),
c AS (SELECT page_id, v, trim(substr(regexp_replace(trim(seg), '[^A-Za-z0-9._-]', '_', 'g'), 1, 180), '. ') AS x FROM s),
f AS (SELECT page_id, CASE WHEN x = '' THEN regexp_replace('page ' || page_id, '[^A-Za-z0-9._-]', '_', 'g') ELSE x END AS file_name FROM c),
e AS (SELECT page_id, file_name, substr(regexp_replace(lower(CASE WHEN contains(file_name, '.') THEN regexp_extract(file_name, '[^.]*$') ELSE 'bin' END), '[^a-z0-9]', '', 'g'), 1, 12) AS e FROM f)
SELECT page_id, file_name, CASE WHEN e = '' THEN 'bin' ELSE e END AS extension FROM e""")
def safe_filename(spark, folder):
    url = F.replace(F.col("url"), F.lit("?"), F.lit("%20&x=%2E"))
    rows = table(spark, folder, "pages").select(
        "page_id", T.safe_file_name(url, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("file_name")
    )
    return rows.withColumn("extension", T.file_extension(F.col("file_name")))


@query("error_compaction", r"""SELECT conv_id, turn, substr(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 160) AS reason FROM conversations""")
def error_compaction(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", T.compact_error(F.col("text")).alias("reason"))
