"""Verified transfers as data: response planning, validation, reducers, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import text as T
from ragspark.operators.ordered import Ordering, Running, scan

STORAGE_KINDS = ("SAF_PERSISTENT", "APK_BUNDLED", "PLAY_SERVICES_MANAGED", "UNAVAILABLE")  # fixed values
SHA256 = "^[0-9a-f]{64}$"
ACTIVE = ("Queued", "Downloading", "Verifying")


def _is_retryable(code: Column) -> Column:
    return code.isin(408, 425, 429) | code.between(500, 599)


# Outcomes of a response, in the order their rules are tried.  ``{}`` marks are filled in.
RESPONSE_RULES = (
    ("FATAL", "Manifest size must be greater than zero"),
    ("FATAL", "Download offset is outside the manifest size"),
    ("RESTART", None),
    ("FATAL", "Server returned more bytes than the manifest allows"),
    ("RETRY", "Server declared a response shorter than the manifest"),
    ("APPEND", None),
    ("FATAL", "206 response did not include a valid Content-Range"),
    ("FATAL", "Content-Range starts at {}, expected {}"),
    ("FATAL", "Content-Range total {} differs from manifest {}"),
    ("FATAL", "Content-Range end is outside the manifest"),
    ("FATAL", "206 response length exceeds Content-Range"),
    ("RETRY", "206 response declared fewer bytes than Content-Range"),
    ("APPEND", None),
    ("RETRY", "Model server returned HTTP {}"),
    ("FATAL", "Model download failed with HTTP {}"),
)


def plan_responses(rows: DataFrame, offset: Column, total: Column, code: Column, range_header: Column, length: Column) -> DataFrame:
    """Add ``plan`` (APPEND, RESTART, RETRY, FATAL), ``expected_bytes`` and ``error`` per response.

    An unknown body length is negative.  A full response to a resumed request restarts it.  The header
    is parsed once; the rules give a rule number, and the outcome is looked up, which keeps the compiled
    code small enough for the JIT.
    """
    r = F.col("_range")
    want = r["end_inclusive"] - r["start"] + 1
    full, partial = code == 200, code == 206
    conditions = (
        total <= 0, (offset < 0) | (offset >= total),
        full & (offset > 0), full & (length > total), full & (length >= 0) & (length < total), full,
        partial & r.isNull(), partial & (r["start"] != offset), partial & (r["total"] != total),
        partial & ((r["end_inclusive"] < r["start"]) | (r["end_inclusive"] >= r["total"])),
        partial & (length > want), partial & (length >= 0) & (length < want), partial,
        _is_retryable(code), F.lit(True),
    )
    rule = F.when(conditions[0], 0)
    for i, condition in enumerate(conditions[1:], start=1):
        rule = rule.when(condition, i)

    def lookup(values: list[str | None]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("_rule"))

    def filled(i: int, *values: Column) -> Column:
        parts = RESPONSE_RULES[i][1].split("{}")
        text = [F.lit(parts[0])]
        for value, after in zip(values, parts[1:]):
            text += [value.cast("string"), F.lit(after)]
        return F.concat(*text)

    number = F.col("_rule")
    error = (
        F.when(number == 7, filled(7, r["start"], offset)).when(number == 8, filled(8, r["total"], total))
        .when(number == 13, filled(13, code)).when(number == 14, filled(14, code))
        .otherwise(lookup([message for _, message in RESPONSE_RULES]))
    )
    ruled = rows.withColumn("_range", F.when(code == 206, T.content_range(range_header))).withColumn("_rule", rule)
    return ruled.select(
        *rows.columns, lookup([plan for plan, _ in RESPONSE_RULES]).alias("plan"),
        F.when(number == 5, total).when(number == 12, want).alias("expected_bytes"), error.alias("error"),
    )


def body_check(expected: Column, actual: Column) -> Column:
    return F.when(actual < expected, "RETRY").when(actual > expected, "FATAL").otherwise("OK")


def manifest_violations(abi: str = "abi") -> Column:
    """Every violated rule of a manifest row, in rule order; an empty array means valid."""
    def blank(c: str) -> Column:
        return T.is_blank(F.coalesce(c, F.lit("")))

    sha = F.lower(T.trim_all(F.col("sha256")))
    labels = F.col(abi)
    rules = [
        ("id", blank("id")), ("display_name", blank("display_name")), ("revision", blank("revision")),
        ("size_bytes", ~F.coalesce(F.col("size_bytes") > 0, F.lit(False))),
        ("sha256", ~F.coalesce(sha.rlike(SHA256), F.lit(False))), ("license", blank("license")),
        ("abi", F.coalesce((F.size(labels) == 0) | F.exists(labels, lambda a: T.is_blank(a)), F.lit(True))),
        ("url", ~F.coalesce(F.lower("url").startswith("https://"), F.lit(False))),
        ("format", blank("format")), ("mime_type", blank("mime_type")),
        ("storage_kind", ~F.coalesce(F.col("storage_kind").isin(*STORAGE_KINDS), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def artifact_violations(size: Column, sha: Column, url: Column) -> Column:
    """Violations that stop a transfer before it starts."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    rules = [
        ("size", ~F.coalesce(size > 0, F.lit(False))),
        ("sha256", ~F.coalesce(F.lower(T.trim_all(sha)).rlike(SHA256), F.lit(False))),
        ("url", ~F.coalesce((F.lower(scheme) == "https") & (host != ""), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(revision: Column, sha: Column, size: Column) -> Column:
    return F.concat_ws(":", revision, F.lower(sha), size.cast("string"))


def recover_status(status: Column, stored_fingerprint: Column, current_fingerprint: Column, downloaded: Column,
                   total: Column, size: Column, storage_kind: Column, message: Column) -> Column:
    """``struct<status,downloaded,total,message>`` exposed after a restart.

    A stale fingerprint forgets everything; work in flight becomes Paused at its checkpoint.
    """
    d, t = F.coalesce(downloaded, F.lit(0).cast("bigint")), F.coalesce(total, size)
    valid = (t == size) & (d >= 0) & (d <= t)

    def out(name: str, progress: bool = False, text: Column | None = None) -> Column:
        none = F.lit(None).cast("bigint")
        return F.struct(
            F.lit(name).alias("status"), (d if progress else none).cast("bigint").alias("downloaded"),
            (t if progress else none).cast("bigint").alias("total"),
            (F.lit(None) if text is None else text).cast("string").alias("message"),
        )

    has_message = ~T.is_blank(F.coalesce(message, F.lit("")))
    return (
        F.when(storage_kind == "UNAVAILABLE", out("Unavailable"))
        .when(~stored_fingerprint.eqNullSafe(current_fingerprint), out("NotInstalled"))
        .when(status == "unavailable", out("Unavailable"))
        .when((status == "queued") & valid, out("Queued", True))
        .when(status.isin("downloading", "verifying", "paused") & valid, out("Paused", True))
        .when(status == "ready", out("Ready"))
        .when((status == "error") & has_message, out("Error", text=message))
        .otherwise(out("NotInstalled"))
    )


def cache_state(storage_kind: Column, size: Column, sha: Column, cached_size: Column, cached_meta: Column, expected_meta: Column) -> Column:
    """HIT / MISS / UNAVAILABLE; any doubt about a cached copy is a miss, never an error."""
    usable = (storage_kind == "SAF_PERSISTENT") & (size > 0) & F.lower(T.trim_all(sha)).rlike(SHA256)
    hit = F.coalesce((cached_size == size) & (cached_meta == expected_meta), F.lit(False))
    return F.when(~F.coalesce(usable, F.lit(False)), "UNAVAILABLE").when(hit, "HIT").otherwise("MISS")


def cache_has_room(available: Column, size: Column) -> Column:
    return available >= size + F.lit(X.CACHE_RESERVE_BYTES)


def cache_metadata(artifact: Column, size: Column, sha: Column, revision: Column, file_name: Column) -> Column:
    lines = (("version", F.lit("2")), ("artifact", artifact), ("size", size.cast("string")),
             ("sha256", F.lower(T.trim_all(sha))), ("revision", revision), ("file", file_name))
    return F.concat(*[p for name, value in lines for p in (F.lit(f"{name}="), value, F.lit("\n"))])


def status_title(status: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, title in X.STATUS_TITLES.items():
        expr = F.when(status == name, title).otherwise(expr)
    return expr


def reduce_transfers(actions: DataFrame, by: Ordering, action: str = "action", amount: str = "bytes", total: str = "total_bytes") -> DataFrame:
    """State after each action of a transfer, without folding a key's actions in one task.

    Start and Error reset the state, so they open segments.  Within one: a transfer downloads until its
    first Pause or Verify, its byte count is the running maximum of legal progress, and Verified completes
    it when all bytes are there.  An illegal action (offset or progress out of range, completion too
    early) is flagged and changes nothing.
    """
    a, n, size = F.col(action), F.col(amount), F.col(total)
    legal_start = (a == "start") & n.between(F.lit(0), size)
    opens = legal_start | (a == "error")
    first = scan(actions, by, {
        "_seg": Running("sum", F.when(opens, 1).otherwise(0)),
        "_kind": Running("last", F.when(opens, a)),
    })
    stop, verify = a.isin("pause", "verify"), a == "verify"
    second = scan(first, by, {
        "_stopped": Running("max", F.when(stop, F.col("_seg")), inclusive=False),
        "_verified": Running("max", F.when(verify, F.col("_seg")), inclusive=False),
    })
    started = F.coalesce(F.col("_kind") == "start", F.lit(False))
    stopped = started & F.coalesce(F.col("_stopped") == F.col("_seg"), F.lit(False))
    verifying = started & F.coalesce(F.col("_verified") == F.col("_seg"), F.lit(False))
    downloading = started & ~stopped
    counted = legal_start | (downloading & (a == "progress") & (n <= size))
    third = scan(second, by, {
        "_bytes": Running("max", F.when(counted, F.struct(F.col("_seg").alias("s"), n.cast("bigint").alias("b")))),
        "_before": Running("max", F.when(counted, F.struct(F.col("_seg").alias("s"), n.cast("bigint").alias("b"))), inclusive=False),
        "_complete": Running("max", F.when(verifying & (a == "verified"), F.struct(F.col("_seg").alias("s"), F.lit(1).alias("x"))), inclusive=False),
    })
    have, before = F.col("_bytes.b"), F.col("_before.b")
    done_before = F.coalesce(F.col("_complete.s") == F.col("_seg"), F.lit(False)) & (have == size)
    now_done = verifying & (a == "verified") & (have == size)
    in_verify = verifying | (started & verify)
    state = (
        F.when(F.col("_kind").isNull(), "Idle").when(F.col("_kind") == "error", "Failed")
        .when(done_before | now_done, "Complete").when(in_verify, "Verifying")
        .when(stopped | (started & stop), "Paused").otherwise("Downloading")
    )
    illegal = (
        ((a == "start") & ~legal_start)
        | (downloading & (a == "progress") & ((n > size) | (n < before)))
        | (verifying & ~done_before & (a == "verified") & (have != size))
    )
    return third.select(
        *actions.columns, state.alias("state"),
        F.when(state.isin("Downloading", "Paused", "Verifying"), have).alias("downloaded"),
        F.coalesce(illegal, F.lit(False)).alias("illegal"),
    )


def pause_fence(events: DataFrame, by: Ordering) -> DataFrame:
    """Which status updates take effect when a pause request races with worker updates.

    ``kind`` is begin, update or pause; ``status`` and ``downloaded`` describe an update.  A pause works
    only on active work, then Queued, Downloading and Verifying updates are ignored until work begins
    again or is Ready.  Adds ``applied`` and the resulting ``new_status`` and ``new_downloaded``.
    """
    kind, status = F.col("kind"), F.col("status")
    shown = F.when(kind == "begin", F.lit("Queued")).when(kind == "update", status)
    opens = (kind == "begin") | ((kind == "update") & (status == "Ready"))
    first = scan(events, by, {
        "_seg": Running("sum", F.when(opens, 1).otherwise(0)),
        "_was": Running("last", F.when(kind != "pause", F.struct(shown.alias("status"), F.col("downloaded").alias("downloaded"))), inclusive=False),
    })
    works = (kind == "pause") & F.coalesce(F.col("_was.status").isin(*ACTIVE), F.lit(False))
    second = scan(first.withColumn("_works", works), by, {
        "_fence": Running("max", F.when(F.col("_works"), F.col("_seg")), inclusive=False),
    })
    fenced = F.coalesce(F.col("_fence") == F.col("_seg"), F.lit(False))
    applied = F.when(kind == "begin", True).when(kind == "pause", F.col("_works") & ~fenced).otherwise(
        ~(fenced & status.isin(*ACTIVE))
    )
    return second.select(
        *events.columns, applied.alias("applied"),
        F.when(applied, F.when(kind == "pause", F.lit("Paused")).otherwise(shown)).alias("new_status"),
        F.when(applied, F.when(kind == "pause", F.col("_was.downloaded")).otherwise(F.col("downloaded"))).alias("new_downloaded"),
    )


def first_requests(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Unique work per key: the first request is kept, later ones are ignored."""
    rest = [c for c in requests.columns if c not in keys]
    return requests.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def work_outcome(error: Column, is_io_error: Column) -> Column:
    """SUCCESS, RETRY for transport errors, FAILURE for the rest."""
    return F.when(error.isNull(), "SUCCESS").when(is_io_error, "RETRY").otherwise("FAILURE")


def required_ready(states: DataFrame, group: list[str], required: DataFrame, id_col: str, ready: Column) -> DataFrame:
    """Per group: are all required ids present and ready (relational division)."""
    n = required.select(id_col).distinct().agg(F.count("*").alias("_need"))
    met = states.where(ready).join(required.select(id_col).distinct(), id_col, "left_semi")
    have = met.select(*group, id_col).distinct().groupBy(*group).agg(F.count("*").alias("_have"))
    everyone = states.select(*group).distinct()
    need = n.first()["_need"]
    return everyone.join(have, group, "left").select(
        *group, (F.coalesce("_have", F.lit(0)) == F.lit(need)).alias("all_ready")
    )
