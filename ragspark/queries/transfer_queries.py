"""Transfers, manifests, status recovery and reducers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T
from ragspark.operators import sequences as Q
from ragspark.operators import transfer as TR
from ragspark.operators.ordered import Ordering, Running, range_bucket, scan
from ragspark.queries.registry import events, plain, query, table

# one response per order line, over a grid of offsets, sizes, codes, lengths and range headers
_GRID = """g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS n, CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 100 ELSE -1 END AS offs,
  CASE WHEN l_suppkey % 10 = 9 THEN 0 ELSE 100 END AS total, list_value(200, 206, 206, 206, 503, 429, 404, 408)[l_orderkey % 8 + 1] AS code,
  list_value(-1, 100, 60, 59, 101, 61)[l_partkey % 6 + 1] AS len,
  list_value('bytes 40-79/100', 'bytes 0-39/100', 'bytes 41-79/100', 'bytes 40-79/*', 'bytes 40-99/100', 'bytes 40-120/100', ' bytes  40-99/100 ', 'bytes 40-99/99', NULL, 'bytes 99999999999999999999-1/2', 'bytes 40-39/100')[(l_orderkey * 7 + l_partkey) % 11 + 1] AS header FROM lineitem)"""


def _pick(options: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


_HEADERS = [
    "bytes 40-79/100", "bytes 0-39/100", "bytes 41-79/100", "bytes 40-79/*", "bytes 40-99/100", "bytes 40-120/100",
    " bytes  40-99/100 ", "bytes 40-99/99", None, "bytes 99999999999999999999-1/2", "bytes 40-39/100",
]


def _grid(spark, folder):
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
        _pick([0, 40, 100, -1], p % 4).cast("bigint").alias("offs"), F.when(s % 10 == 9, 0).otherwise(100).cast("bigint").alias("total"),
        _pick([200, 206, 206, 206, 503, 429, 404, 408], k % 8).alias("code"),
        _pick([-1, 100, 60, 59, 101, 61], p % 6).cast("bigint").alias("len"), _pick(_HEADERS, (k * 7 + p) % 11).alias("header"),
    )


_KEY = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"
_RANGE = r"^bytes\s+(\d+)-(\d+)/(\d+)$"
_PARSED = f"""r AS (SELECT *, TRY_CAST(regexp_extract(trim(header), '{_RANGE}', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(trim(header), '{_RANGE}', 2) AS BIGINT) AS b,
  TRY_CAST(regexp_extract(trim(header), '{_RANGE}', 3) AS BIGINT) AS t FROM g),
v AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL AS ok FROM r)"""


@query("content_range_parse", f"""WITH {_GRID}, {_PARSED} SELECT {_KEY}, CASE WHEN ok THEN a END AS start, CASE WHEN ok THEN b END AS end_inclusive, CASE WHEN ok THEN t END AS total_bytes FROM v""")
def content_range_parse(spark, folder):
    rows = _grid(spark, folder).withColumn("r", T.content_range(F.col("header")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.start", "r.end_inclusive", F.col("r.total").alias("total_bytes")
    )


@query("transfer_plan", f"""WITH {_GRID}, {_PARSED}, e AS (SELECT *, CASE
  WHEN total <= 0 THEN 'FATAL|Manifest size must be greater than zero' WHEN offs < 0 OR offs >= total THEN 'FATAL|Download offset is outside the manifest size'
  WHEN code = 200 AND offs > 0 THEN 'RESTART|' WHEN code = 200 AND len > total THEN 'FATAL|Server returned more bytes than the manifest allows'
  WHEN code = 200 AND len >= 0 AND len < total THEN 'RETRY|Server declared a response shorter than the manifest' WHEN code = 200 THEN 'APPEND|'
  WHEN code = 206 AND NOT ok THEN 'FATAL|206 response did not include a valid Content-Range'
  WHEN code = 206 AND a <> offs THEN 'FATAL|Content-Range starts at ' || a || ', expected ' || offs
  WHEN code = 206 AND t <> total THEN 'FATAL|Content-Range total ' || t || ' differs from manifest ' || total
  WHEN code = 206 AND (b < a OR b >= t) THEN 'FATAL|Content-Range end is outside the manifest'
  WHEN code = 206 AND len > b - a + 1 THEN 'FATAL|206 response length exceeds Content-Range'
  WHEN code = 206 AND len >= 0 AND len < b - a + 1 THEN 'RETRY|206 response declared fewer bytes than Content-Range' WHEN code = 206 THEN 'APPEND|'
  WHEN code IN (408, 425, 429) OR code BETWEEN 500 AND 599 THEN 'RETRY|Model server returned HTTP ' || code ELSE 'FATAL|Model download failed with HTTP ' || code END AS o FROM v)
SELECT {_KEY}, split_part(o, '|', 1) AS plan, CASE WHEN o = 'APPEND|' THEN CASE WHEN code = 200 THEN total ELSE b - a + 1 END END AS expected_bytes, nullif(split_part(o, '|', 2), '') AS error FROM e""")
def transfer_plan(spark, folder):
    rows = TR.plan_responses(_grid(spark, folder), F.col("offs"), F.col("total"), F.col("code"), F.col("header"), F.col("len"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "plan", "expected_bytes", "error")


@query("body_check", f"WITH {_GRID} SELECT {_KEY}, CASE WHEN len < 60 THEN 'RETRY' WHEN len > 60 THEN 'FATAL' ELSE 'OK' END AS verdict FROM g")
def body_check(spark, folder):
    return _grid(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", TR.body_check(F.lit(60), F.col("len")).alias("verdict"))


_MANIFEST = """m AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'model-' || (p_partkey - p_partkey % 17 // 16) END AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS display_name,
  CASE WHEN p_partkey % 7 = 0 THEN 'http://x.example/' || p_partkey ELSE 'HTTPS://x.example/' || p_partkey END AS url, p_brand AS revision, CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS size_bytes,
  CASE WHEN p_partkey % 5 = 0 THEN 'zz' || substr(sha256(p_name), 3) WHEN p_partkey % 5 = 1 THEN ' ' || upper(sha256(p_name)) ELSE sha256(p_name) END AS sha256, 'MIT' AS license,
  CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['arm64-v8a', ' '] ELSE ['any'] END AS abi, CASE WHEN p_partkey % 3 = 0 THEN 'FLOPPY' ELSE 'SAF_PERSISTENT' END AS storage_kind,
  p_type AS format, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'text/plain' END AS mime_type FROM part)"""


def _manifest(spark, folder):
    k = F.col("p_partkey")
    digest = F.sha2("p_name", 256)
    ident = k - F.call_function("div", k % 17, F.lit(16))
    return table(spark, folder, "part").select(
        "p_partkey", F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("model-"), ident.cast("string"))).alias("id"),
        F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("display_name"),
        F.concat(F.when(k % 7 == 0, "http://x.example/").otherwise("HTTPS://x.example/"), k.cast("string")).alias("url"),
        F.col("p_brand").alias("revision"), F.when(k % 19 == 0, 0).otherwise(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("size_bytes"),
        F.when(k % 5 == 0, F.concat(F.lit("zz"), F.substring(digest, 3, 62))).when(k % 5 == 1, F.concat(F.lit(" "), F.upper(digest))).otherwise(digest).alias("sha256"),
        F.lit("MIT").alias("license"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("arm64-v8a"), F.lit(" "))).otherwise(F.array(F.lit("any"))).alias("abi"),
        F.when(k % 3 == 0, "FLOPPY").otherwise("SAF_PERSISTENT").alias("storage_kind"), F.col("p_type").alias("format"),
        F.when(k % 23 == 0, F.lit(None)).otherwise("text/plain").alias("mime_type"),
    )


_SHA_OK = "regexp_full_match(lower(trim(sha256)), '[0-9a-f]{64}')"


@query("manifest_validate", f"""WITH {_MANIFEST} SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN trim(id) = '' THEN 'id' END, CASE WHEN trim(display_name) = '' THEN 'display_name' END, CASE WHEN trim(revision) = '' THEN 'revision' END, CASE WHEN size_bytes <= 0 THEN 'size_bytes' END,
  CASE WHEN NOT {_SHA_OK} THEN 'sha256' END, CASE WHEN trim(license) = '' THEN 'license' END, CASE WHEN len(abi) = 0 OR list_contains(abi, ' ') THEN 'abi' END, CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'url' END,
  CASE WHEN trim(format) = '' THEN 'format' END, CASE WHEN mime_type IS NULL THEN 'mime_type' END, CASE WHEN storage_kind NOT IN ('SAF_PERSISTENT') THEN 'storage_kind' END], lambda x: x IS NOT NULL), ' ') AS violations,
  array_to_string(list_filter([CASE WHEN size_bytes <= 0 THEN 'size' END, CASE WHEN NOT {_SHA_OK} THEN 'sha256' END, CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'url' END], lambda x: x IS NOT NULL), ' ') AS blocked FROM m""")
def manifest_validate(spark, folder):
    return _manifest(spark, folder).select(
        "p_partkey", F.array_join(TR.manifest_violations(), " ").alias("violations"),
        F.array_join(TR.artifact_violations(F.col("size_bytes"), F.col("sha256"), F.col("url")), " ").alias("blocked"),
    )


@query("manifest_duplicates", f"WITH {_MANIFEST} SELECT id, count(*) AS n FROM m GROUP BY id HAVING count(*) > 1")
def manifest_duplicates(spark, folder):
    return TR.duplicate_keys(_manifest(spark, folder), ["id"])


@query("manifest_json", f"""WITH {_MANIFEST} SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'unsupported schema version' END AS manifest_error, id, coalesce(mime_type, 'application/octet-stream') AS mime_type, size_bytes FROM m""")
def manifest_json(spark, folder):
    """Each part as a one-artifact manifest file, written as JSON and read back; a missing type gets its default."""
    from ragspark.sources.codecs import manifest_rows
    m = _manifest(spark, folder)
    artifact = F.struct(
        "id", F.col("display_name").alias("displayName"), "url", "revision", F.col("size_bytes").alias("sizeBytes"), "sha256", "license", "abi",
        F.col("storage_kind").alias("storageKind"), F.col("p_partkey").cast("string").alias("format"), F.col("mime_type").alias("mimeType"),
    )
    version = F.when(F.col("p_partkey") % 3 == 1, 2).otherwise(1)
    bodies = m.select(F.to_json(F.struct(version.alias("schemaVersion"), F.array(artifact).alias("artifacts"))).alias("body"))
    return manifest_rows(bodies, "body").select(F.col("format").cast("bigint").alias("p_partkey"), "manifest_error", "id", "mime_type", "size_bytes")


@query("status_recover", """WITH s AS (SELECT o_orderkey, list_value('not_installed', 'unavailable', 'queued', 'downloading', 'verifying', 'paused', 'ready', 'error', 'odd')[o_orderkey % 9 + 1] AS status,
  o_orderkey % 11 = 0 AS gone, o_orderkey % 5 = 0 AS stale, CASE WHEN o_orderkey % 6 <> 5 THEN o_custkey - 20 END AS downloaded, CASE WHEN o_orderkey % 4 = 3 THEN 999 WHEN o_orderkey % 4 = 2 THEN NULL ELSE 1000 END AS total,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE ' ' END AS message FROM orders),
v AS (SELECT *, coalesce(downloaded, 0) AS d, coalesce(total, 1000) AS t FROM s), w AS (SELECT *, t = 1000 AND d >= 0 AND d <= t AS ok FROM v),
z AS (SELECT *, CASE WHEN gone THEN 'Unavailable' WHEN stale THEN 'NotInstalled' WHEN status = 'unavailable' THEN 'Unavailable' WHEN status = 'queued' AND ok THEN 'Queued' WHEN status IN ('downloading', 'verifying', 'paused') AND ok THEN 'Paused'
  WHEN status = 'ready' THEN 'Ready' WHEN status = 'error' AND trim(message) <> '' THEN 'Error' ELSE 'NotInstalled' END AS now FROM w)
SELECT o_orderkey, now AS status, CASE WHEN now IN ('Queued', 'Paused') THEN CAST(d AS BIGINT) END AS downloaded, CASE WHEN now IN ('Queued', 'Paused') THEN CAST(t AS BIGINT) END AS total, CASE WHEN now = 'Error' THEN message END AS message,
  CASE now WHEN 'NotInstalled' THEN 'Local chat is unavailable' WHEN 'Queued' THEN 'Download queued' WHEN 'Paused' THEN 'Download paused' WHEN 'Error' THEN 'Model download needs attention' WHEN 'Unavailable' THEN 'Local model unavailable' ELSE 'Local model ready' END AS title FROM z""")
def status_recover(spark, folder):
    k = F.col("o_orderkey")
    status = _pick(["not_installed", "unavailable", "queued", "downloading", "verifying", "paused", "ready", "error", "odd"], k % 9)
    current = TR.fingerprint(F.lit("r1"), F.upper(F.sha2("o_orderpriority", 256)), F.lit(1000))
    stored = F.when(k % 5 == 0, F.concat(current, F.lit("0"))).otherwise(current)
    out = TR.recover_status(
        status, stored, current, F.when(k % 6 != 5, F.col("o_custkey") - 20), F.when(k % 4 == 3, 999).when(k % 4 == 2, F.lit(None)).otherwise(1000).cast("bigint"),
        F.lit(1000).cast("bigint"), F.when(k % 11 == 0, "UNAVAILABLE").otherwise("SAF_PERSISTENT"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(" "),
    )
    rows = table(spark, folder, "orders").withColumn("s", out).select("o_orderkey", "s.*")
    return rows.withColumn("title", TR.status_title(F.col("status")))


@query("cache_states", f"""WITH {_MANIFEST} SELECT p_partkey, CASE WHEN storage_kind <> 'SAF_PERSISTENT' OR size_bytes <= 0 OR NOT {_SHA_OK} THEN 'UNAVAILABLE' WHEN p_partkey % 2 = 0 AND p_partkey % 10 <> 2 THEN 'HIT' ELSE 'MISS' END AS state,
  50000000 >= size_bytes * 300 + 16777216 AS room, sha256('version=2' || chr(10) || 'artifact=' || id || chr(10) || 'size=' || size_bytes || chr(10) || 'sha256=' || lower(trim(sha256)) || chr(10) || 'revision=' || revision || chr(10) || 'file=' || format || chr(10)) AS meta_id FROM m""")
def cache_states(spark, folder):
    m = _manifest(spark, folder)
    meta = TR.cache_metadata(F.col("id"), F.col("size_bytes"), F.col("sha256"), F.col("revision"), F.col("format"))
    k = F.col("p_partkey")
    state = TR.cache_state(
        F.col("storage_kind"), F.col("size_bytes"), F.col("sha256"), F.when(k % 2 == 0, F.col("size_bytes")),
        F.when(k % 10 == 2, F.concat(meta, F.lit("\n"))).otherwise(meta), meta,
    )
    return m.select("p_partkey", state.alias("state"), TR.cache_has_room(F.lit(50_000_000), F.col("size_bytes") * 300).alias("room"), F.sha2(meta, 256).alias("meta_id"))


@query("required_ready", """WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders)
SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) = 2 AS all_ready FROM s GROUP BY o_custkey""")
def required_ready(spark, folder):
    """Customers whose urgent and high orders each have one that is ready (filled)."""
    o = table(spark, folder, "orders")
    required = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderpriority").distinct()
    return TR.required_ready(o, ["o_custkey"], required, "o_orderpriority", F.col("o_orderstatus") == "F")


@query("work_outcomes", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'SUCCESS' WHEN event_id % 2 = 0 THEN 'RETRY' ELSE 'FAILURE' END AS outcome FROM events""")
def work_outcomes(spark, folder):
    i = F.col("event_id")
    return table(spark, folder, "events").select("event_id", TR.work_outcome(F.when(i % 3 != 0, "failed"), i % 2 == 0).alias("outcome"))


@query("first_requests", """SELECT user_id, event_type, min(event_id) AS event_id, round(arg_min(value, ts), 6) AS value FROM events GROUP BY ALL""")
def first_requests(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return plain(TR.first_requests(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"))


# actions from events: the type and value of an event say what happened to the user's transfer
_ACTIONS = """a AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 11 = 0 THEN 'start' WHEN event_id % 29 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'verified' WHEN event_id % 7 = 0 THEN 'verify' WHEN event_id % 17 = 0 THEN 'pause' ELSE 'progress' END AS action,
  CASE WHEN event_id % 11 = 0 THEN event_id % 120 WHEN event_id % 3 = 0 THEN 100 ELSE event_id * 31 % 104 END AS bytes FROM events)"""


def _actions(spark, folder):
    e, by = events(spark, folder)
    i = F.col("event_id")
    action = (
        F.when(i % 11 == 0, "start").when(i % 29 == 0, "error").when(i % 13 == 0, "verified").when(i % 7 == 0, "verify")
        .when(i % 17 == 0, "pause").otherwise("progress")
    )
    amount = F.when(i % 11 == 0, i % 120).when(i % 3 == 0, 100).otherwise(i * 31 % 104)
    return e.select("user_id", "event_id", "ts_ms", "_bucket", action.alias("action"), amount.alias("bytes"), F.lit(100).cast("bigint").alias("total_bytes")), by


# the oracle replays the machine action by action
@query("transfer_reduce", f"""WITH RECURSIVE {_ACTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM a),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, 'Idle' AS state, CAST(NULL AS BIGINT) AS d, false AS illegal FROM (SELECT DISTINCT user_id FROM n)
 UNION ALL SELECT n.user_id, n.event_id, n.i,
  CASE WHEN action = 'start' AND bytes BETWEEN 0 AND 100 THEN 'Downloading' WHEN action = 'error' THEN 'Failed' WHEN action = 'pause' AND state = 'Downloading' THEN 'Paused'
    WHEN action = 'verify' AND state IN ('Downloading', 'Paused') THEN 'Verifying' WHEN action = 'verified' AND state = 'Verifying' AND d = 100 THEN 'Complete' ELSE state END,
  CASE WHEN action = 'start' AND bytes BETWEEN 0 AND 100 THEN bytes WHEN action = 'error' THEN NULL WHEN action = 'progress' AND state = 'Downloading' AND bytes BETWEEN d AND 100 THEN bytes
    WHEN action = 'verified' AND state = 'Verifying' AND d = 100 THEN NULL ELSE d END,
  (action = 'start' AND bytes NOT BETWEEN 0 AND 100) OR (action = 'progress' AND state = 'Downloading' AND bytes NOT BETWEEN d AND 100) OR (action = 'verified' AND state = 'Verifying' AND d <> 100)
 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, event_id, state, d AS downloaded, illegal FROM f WHERE i > 0""")
def transfer_reduce(spark, folder):
    actions, by = _actions(spark, folder)
    return plain(TR.reduce_transfers(actions, by).select("user_id", "event_id", "state", "downloaded", "illegal"))


_FENCE = """a AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 23 = 0 THEN 'begin' WHEN event_id % 5 = 0 THEN 'pause' ELSE 'update' END AS kind,
  list_value('Downloading', 'Queued', 'Downloading', 'Verifying', 'Downloading', 'Error', 'Ready')[event_id * 3 % 7 + 1] AS status, event_id % 100 AS b FROM events)"""


@query("pause_fence", f"""WITH RECURSIVE {_FENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM a),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, 'NotInstalled' AS state, CAST(NULL AS BIGINT) AS d, false AS paused, false AS applied FROM (SELECT DISTINCT user_id FROM n)
 UNION ALL SELECT user_id, event_id, i, CASE WHEN NOT ok THEN state WHEN kind = 'begin' THEN 'Queued' WHEN kind = 'pause' THEN 'Paused' ELSE status END, CASE WHEN NOT ok OR kind = 'pause' THEN d ELSE b END,
   CASE WHEN kind = 'begin' OR (ok AND kind = 'update' AND status = 'Ready') THEN false WHEN kind = 'pause' AND ok THEN true ELSE paused END, ok
 FROM (SELECT n.*, f.state, f.d, f.paused, CASE n.kind WHEN 'begin' THEN true WHEN 'pause' THEN f.state IN ('Queued', 'Downloading', 'Verifying') ELSE NOT (f.paused AND n.status IN ('Queued', 'Downloading', 'Verifying')) END AS ok
   FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1))
SELECT user_id, event_id, applied, CASE WHEN applied THEN state END AS new_status, CASE WHEN applied THEN d END AS new_downloaded FROM f WHERE i > 0""")
def pause_fence(spark, folder):
    e, by = events(spark, folder)
    i = F.col("event_id")
    rows = e.select(
        "user_id", "event_id", "ts_ms", "_bucket", F.when(i % 23 == 0, "begin").when(i % 5 == 0, "pause").otherwise("update").alias("kind"),
        _pick(["Downloading", "Queued", "Downloading", "Verifying", "Downloading", "Error", "Ready"], i * 3 % 7).alias("status"), (i % 100).alias("downloaded"),
    )
    return plain(TR.pause_fence(rows, by).select("user_id", "event_id", "applied", "new_status", "new_downloaded"))


@query("progress_steps", f"""WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS BIGINT) AS done, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey) AS BIGINT) AS total, row_number() OVER w AS i
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT o_custkey, o_orderkey, i, done, done AS shown, done = total OR done >= 0 AS emit FROM e WHERE i = 1
 UNION ALL SELECT e.o_custkey, e.o_orderkey, e.i, e.done, CASE WHEN e.done = e.total OR e.done - f.shown >= {X.PROGRESS_STEP_BYTES} THEN e.done ELSE f.shown END, e.done = e.total OR e.done - f.shown >= {X.PROGRESS_STEP_BYTES}
  FROM f JOIN e ON e.o_custkey = f.o_custkey AND e.i = f.i + 1)
SELECT o_custkey, o_orderkey, done FROM f WHERE emit""")
def progress_steps(spark, folder):
    """Running order value per customer as transfer progress."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("n"))
    by = Ordering(("o_custkey",), ("o_orderkey",))
    rows = scan(o.withColumn("_bucket", range_bucket(F.col("o_orderkey"), 1_000_000)), by, {"done": Running("sum", F.col("n"))})
    rows = rows.join(o.groupBy("o_custkey").agg(F.sum("n").alias("total")), "o_custkey")
    return Q.progress_steps(rows, ["o_custkey"], "o_orderkey", "done", "total").select("o_custkey", "o_orderkey", "done")
