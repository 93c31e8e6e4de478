"""Registered queries opN_<name>: each operator over its whole table, with DuckDB SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import attribution, bytebpe, decontaminate, hardneg, kdshards, langid, linededup, lmscore, pieces, prefixtrie, repetition, simhash, toxicity
from ragspark.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
PHRASE_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({PHRASE_WORDS.format(LOWER.format('text'))}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({PHRASE_WORDS.format(LOWER.format('text'))}, []) AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS phrase
  FROM b, LATERAL unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 12) END)) u(i)),
sizes AS (SELECT DISTINCT size FROM windows),
here AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS phrase
  FROM d, sizes, LATERAL unnest(range(0, greatest(0, len(w) - size + 1))) u(i)),
found AS (SELECT h.doc_id, h.size, h.i, x.item_id FROM here h JOIN windows x USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op2_simhash")
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({WORDS.format('text')}, []) AS w FROM documents),
lines AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
short AS (
  SELECT doc_id, i, n, {" || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(5))} AS p5,
    md5({" || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(8))}) AS p8
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
long AS (
  SELECT *, md5({" || ".join(f"lead(p8, {k}) OVER o" for k in [*range(0, 96, 8), 93])}) AS p101
  FROM short WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS ({" UNION ALL ".join(f"""
  SELECT doc_id, {k} AS size, i, count(*) OVER (PARTITION BY doc_id, p{k}) AS n FROM long WHERE i + {k} <= n""" for k in (5, 8, 101))}),
cover AS (
  SELECT doc_id, count(DISTINCT p) FILTER (size = 8) AS n_repeat_words, count(DISTINCT p) FILTER (size = 5) AS n_covered,
    count(*) FILTER (size = 101) AS n_long
  FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_covered, 0) AS BIGINT) AS n_covered, coalesce(n_long, 0) AS n_long
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_covered <= 40 * n_words AND n_long = 0 AS kept
FROM counted"""


@query("op3_repetition", OP3_SQL)
def op3_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition_report(table(spark, folder, "documents")).drop("longest_repeat")


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, line, i, {LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i)),
often AS (SELECT key FROM lines WHERE len(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o USING (key) GROUP BY doc_id"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.line_report(table(spark, folder, "documents"))


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, folder, "documents"))


@query("op7_kd_shards")
def op7_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kdshards.kd_shards(table(spark, folder, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_section_tokens")
def op9_section_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.section_tokens(table(spark, folder, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_cross_entropy")
def op6_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return lmscore.cross_entropy_difference(table(spark, folder, "documents"), good)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id, s.b) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bytebpe.encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")


CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
CRC32 = f"""xor(4294967295, list_reduce(list_transform(string_split({{0}}, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: list_reduce(range(8), lambda x, k: {CRC_STEP}, xor(a, b)), CAST(4294967295 AS BIGINT)))"""

OP13_SQL = f"""
WITH o AS (
  SELECT conv_id, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST) AS t,
    {CRC32.format('CAST(conv_id AS VARCHAR)')} % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.t[1 : a.h], []), a.t[a.h + 1 :]) AS t
  FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (
  SELECT conv_id, d, md5(array_to_string(list_transform(t[1 : d], lambda x: md5(x)), '')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(t[1 : d - 1], lambda x: md5(x)), '')) END AS up,
    CASE WHEN d > 0 THEN strlen(substr(t[d], instr(t[d], chr(0)) + 1)) ELSE 0 END AS size, len(t) = d AS ends
  FROM r, LATERAL unnest(range(0, len(t) + 1)) u(d)),
n AS (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, node),
c AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, node)),
below AS (
  SELECT a.d, a.node, sum(k.saved) AS saved, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM k JOIN p a ON a.conv_id = k.conv_id AND a.d <= k.d GROUP BY a.d, a.node)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN below USING (d, node) LEFT JOIN n u ON u.d = k.d - 1 AND u.node = k.up"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns = prefixtrie.original_turns(table(spark, folder, "conversations"))
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, taken, most=8))
