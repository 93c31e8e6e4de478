"""Batch forms of the ordered-event operators, translation guards, audio and layout geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import audio as A
from ragspark.functions import fixed as X
from ragspark.functions import geometry as G
from ragspark.functions import text as T
from ragspark.operators import sequences as Q
from ragspark.operators import translation as L
from ragspark.operators.chunking import chunk_text
from ragspark.operators.ordered import Ordering, by_count, range_bucket
from ragspark.queries.registry import documents, events, plain, query, sql_chunks, sql_trim, table

HOUR_MS = 3_600_000
_W = "PARTITION BY user_id ORDER BY epoch_ms(ts), event_id"


@query("debounce", f"""SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' THEN 'CLEAR' ELSE 'FIRE' END AS action
FROM (SELECT *, lead(epoch_ms(ts)) OVER ({_W}) - epoch_ms(ts) AS gap FROM events) WHERE gap IS NULL OR gap >= {HOUR_MS}""")
def debounce(spark, folder):
    e, by = events(spark, folder)
    rows = e.withColumn("text", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")))
    return Q.debounce(rows, by, "ts_ms", HOUR_MS, "text").select("user_id", "event_id", "event_type", "action")


@query("dedup_consecutive", f"""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER ({_W}) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def dedup_consecutive(spark, folder):
    e, by = events(spark, folder)
    return Q.drop_repeats(e, by, ["event_type"]).select("user_id", "event_id", "event_type")


@query("latest_wins", """SELECT user_id, event_id, event_type, event_id // 50 AS generation FROM events e
WHERE event_id // 50 = (SELECT max(event_id // 50) FROM events x WHERE x.user_id = e.user_id)""")
def latest_wins(spark, folder):
    rows = table(spark, folder, "events").withColumn("generation", F.call_function("div", F.col("event_id"), F.lit(50)))
    return Q.latest_wins(rows, ["user_id"], "generation").select("user_id", "event_id", "event_type", "generation")


@query("drop_oldest_64", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) <= 64""")
def drop_oldest_64(spark, folder):
    e, _ = events(spark, folder)
    return Q.drop_oldest(e, ["user_id"], ["ts_ms", "event_id"]).select("user_id", "event_id")


@query("keep_latest", """SELECT user_id, epoch_ms(ts) // 86400000 AS day, max_by(event_id, (epoch_ms(ts), event_id)) AS event_id FROM events GROUP BY ALL""")
def keep_latest(spark, folder):
    e, _ = events(spark, folder)
    rows = e.select("user_id", F.col("_bucket").alias("day"), "event_id", "ts_ms")
    return Q.keep_latest(rows, ["user_id", "day"], ["ts_ms", "event_id"]).select("user_id", "day", "event_id")


@query("single_flight", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, epoch_ms(ts) + (event_id % 5) * {HOUR_MS} AS done, row_number() OVER ({_W}) AS i FROM events),
f AS (SELECT user_id, event_id, i, done AS free, true AS taken FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t >= f.free THEN e.done ELSE f.free END, e.t >= f.free FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id FROM f WHERE taken""")
def single_flight(spark, folder):
    """Events as frames of their user that take up to four hours each; one that comes meanwhile is dropped."""
    e, by = events(spark, folder)
    rows = e.withColumn("busy_ms", (F.col("event_id") % 5) * HOUR_MS)
    return Q.single_flight(rows, by, "ts_ms", "busy_ms").select("user_id", "event_id")


_FRAMES = f"""fr AS (SELECT user_id, event_id, row_number() OVER ({_W}) AS seq, CAST(value / 500 AS FLOAT) >= CAST(0.018 AS FLOAT) AS speech FROM events)"""


def _frames(spark, folder):
    """Events as loudness frames of their user, densely numbered."""
    e, by = events(spark, folder)
    rows = Q.with_index(e.select("user_id", "event_id", "ts_ms", "_bucket", "value"), by)
    speech = A.is_speech((F.col("value") / 500).cast("float"))
    by_seq = Ordering(("user_id",), ("seq",), "_block_no")
    return rows.withColumn("speech", speech).withColumn("_block_no", range_bucket(F.col("seq"), 4096)), by_seq


_RUNS = f"""WITH {_FRAMES}, m AS (SELECT *, max(CASE WHEN NOT speech THEN seq END) OVER w AS s0, max(CASE WHEN speech THEN seq END) OVER w AS s1 FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, event_id, seq, seq - coalesce(s0, 0) AS speech_run, seq - coalesce(s1, 0) AS silence_run FROM m"""


@query("speech_runs", _RUNS)
def speech_runs(spark, folder):
    frames, by = _frames(spark, folder)
    return plain(Q.run_lengths(frames, by, F.col("speech")).select("user_id", "event_id", "seq", "speech_run", "silence_run"))


@query("speech_runs_by_count", _RUNS)
def speech_runs_by_count(spark, folder):
    """The same over buckets of bounded size, however many frames of a user fall on one day."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    rows, by = by_count(e, ["user_id"], ["ts", "event_id"])
    frames = Q.with_index(rows, by).withColumn("speech", A.is_speech((F.col("value") / 500).cast("float")))
    runs = Q.run_lengths(frames, Ordering(by.keys, ("seq",), by.bucket), F.col("speech"))
    return plain(runs.select("user_id", "event_id", "seq", "speech_run", "silence_run"))


@query("pre_roll", f"""WITH {_FRAMES} SELECT user_id, seq, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS held FROM fr""")
def pre_roll(spark, folder):
    frames, _ = _frames(spark, folder)
    rows = Q.pre_roll(frames, ["user_id"], "event_id", block_rows=256)
    return rows.select("user_id", "seq", F.array_join("pre_roll", ",").alias("held"))


@query("vad_segments", f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER ({_W}) AS seq, value >= 9 AND event_id % 1900 < 950 AS speech, 3200 AS n, 200 * row_number() OVER ({_W}) AS t FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, false AS on_air, CAST(0 AS BIGINT) AS sp, CAST(0 AS BIGINT) AS si, CAST(0 AS BIGINT) AS ring, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS lastp, false AS part, '' AS ended, CAST(0 AS BIGINT) AS kept_first, CAST(0 AS BIGINT) AS kept_total FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, seq, CASE WHEN ended <> '' THEN false WHEN starts THEN true ELSE was END, CASE WHEN ended <> '' THEN 0 ELSE sp2 END, CASE WHEN ended <> '' OR starts THEN 0 ELSE si2 END,
   CASE WHEN ended <> '' OR was OR starts THEN 0 ELSE ring2 END, CASE WHEN ended <> '' THEN 0 WHEN starts THEN seq - ring2 + 1 ELSE first END, CASE WHEN ended <> '' THEN 0 WHEN starts THEN ring2 * 3200 ELSE total2 END,
   CASE WHEN ended <> '' THEN 0 WHEN starts OR part THEN t ELSE lastp END, part, ended, first, total2
 FROM (SELECT *, CASE WHEN was AND si2 >= 35 THEN 'SILENCE' WHEN was AND total2 >= 480000 THEN 'MAX_LENGTH' ELSE '' END AS ended, NOT was AND sp2 >= 2 AS starts, was AND total2 >= 16000 AND t - lastp >= 1200 AS part FROM (
   SELECT e.user_id, e.seq, e.t, f.on_air AS was, f.first, f.lastp, CASE WHEN f.on_air THEN f.sp WHEN e.speech THEN f.sp + 1 ELSE 0 END AS sp2, CASE WHEN NOT f.on_air THEN 0 WHEN e.speech THEN 0 ELSE f.si + 1 END AS si2,
     least(8, f.ring + 1) AS ring2, CASE WHEN f.on_air THEN f.total + 3200 ELSE 0 END AS total2 FROM f JOIN e ON e.user_id = f.user_id AND e.seq = f.seq + 1))),
last AS (SELECT user_id, max(seq) AS seq FROM e GROUP BY user_id)
SELECT user_id, 'PARTIAL' AS kind, kept_first AS start_seq, seq AS end_seq, kept_total AS n_samples, 'CADENCE' AS reason FROM f WHERE part
UNION ALL SELECT user_id, 'FINAL', kept_first, seq, kept_total, ended FROM f WHERE ended <> '' AND kept_total >= 8000
UNION ALL SELECT user_id, 'FINAL', first, seq, total, 'END_OF_STREAM' FROM f JOIN last USING (user_id, seq) WHERE on_air AND total >= 8000""")
def vad_segments(spark, folder):
    """Voice-activity segments over events as 200 ms frames; the oracle replays the machine frame by frame."""
    frames, by = _frames(spark, folder)
    speech = (F.col("value") >= 9) & (F.col("event_id") % 1900 < 950)
    rows = Q.utterances(frames, by, speech, F.lit(3200), F.col("seq") * 200)
    return plain(rows.select("user_id", "kind", "start_seq", "end_seq", "n_samples", "reason"))


@query("live_phases", f"""WITH RECURSIVE n AS (SELECT user_id, event_id, row_number() OVER ({_W}) AS i, list_value('Start', 'Ready', 'Partial', 'Final', 'Translated', 'TranslateFailed', 'Spoken', 'Partial', 'Final', 'Translated')[event_id % 10 + 1] AS ev,
  event_id % 997 = 500 AS bad, event_id % 4 = 0 AS blank, event_id % 3 = 0 AS speak FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, '' AS phase, false AS dead, false AS ignored FROM (SELECT DISTINCT user_id FROM n)
 UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN f.dead OR bad THEN 'Error' WHEN ev = 'Start' THEN 'Starting' WHEN ev = 'Partial' THEN 'Transcribing' WHEN ev = 'Final' AND NOT blank THEN 'Translating' WHEN ev = 'Translated' AND NOT blank AND speak THEN 'Speaking' ELSE 'Listening' END, f.dead OR bad, f.dead
  FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, event_id, phase, ignored FROM f WHERE i > 0""")
def live_phases(spark, folder):
    e, by = events(spark, folder)
    i = F.col("event_id")
    names = ["Start", "Ready", "Partial", "Final", "Translated", "TranslateFailed", "Spoken", "Partial", "Final", "Translated"]
    event = F.when(i % 997 == 500, "Failed").otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), (i % 10 + 1).cast("int")))
    rows = e.select("user_id", "event_id", "ts_ms", "_bucket", event.alias("event"), F.when(i % 4 == 0, " ").otherwise("x").alias("text"), (i % 3 == 0).alias("speak"))
    return Q.live_phases(rows, by).select("user_id", "event_id", "phase", "ignored")


@query("distinct_states", f"""SELECT user_id, event_id, value > 50 AS high FROM (SELECT *, lag(value > 50) OVER ({_W}) AS p FROM events) WHERE p IS DISTINCT FROM (value > 50)""")
def distinct_states(spark, folder):
    e, by = events(spark, folder)
    return Q.drop_repeats(e.withColumn("high", F.col("value") > 50), by, ["high"]).select("user_id", "event_id", "high")


# Audio: the words of a chunk are the samples of one frame ---------------------------------------

_SAMPLES = f"""{sql_chunks()}, s AS (SELECT doc_id, ordinal, list_transform(string_split(text, ' '), lambda x: CAST((ascii(x) * 7919 + len(x) * 104729) % 65536 - 32768 AS BIGINT)) AS x FROM chunks)"""


@query("audio_rms", f"""WITH {_SAMPLES} SELECT doc_id, ordinal, round(CAST(CAST(sqrt(list_sum(list_transform(x, lambda v: (v / 32767.0::DOUBLE) * (v / 32767.0::DOUBLE))) / len(x)) AS FLOAT) AS DOUBLE), 6) AS loudness,
  round(list_sum(list_transform(x, lambda v: CAST(CAST(v / 32768.0::DOUBLE AS FLOAT) AS DOUBLE))), 6) AS total FROM s""")
def audio_rms(spark, folder):
    sample = F.transform(F.split("text", " "), lambda w: ((F.ascii(w) * 7919 + F.length(w) * 104729) % 65536 - 32768).cast("smallint"))
    rows = chunk_text(documents(spark, folder), "doc_id").select("doc_id", "ordinal", sample.alias("x"))
    return plain(rows.select(
        "doc_id", "ordinal", A.rms(F.col("x")).alias("loudness"),
        F.aggregate(A.pcm_to_float(F.col("x")), F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"),
    ))


@query("read_states", """SELECT event_id, CASE WHEN event_id % 9 - 6 > 0 THEN 'DATA' WHEN event_id % 9 = 6 THEN 'EMPTY' ELSE 'TERMINAL' END AS state FROM events""")
def read_states(spark, folder):
    return table(spark, folder, "events").select("event_id", A.read_state(F.col("event_id") % 9 - 6).alias("state"))


# Translation ----------------------------------------------------------------------------------

@query("language_options", """WITH t AS (SELECT lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) ELSE lang END)) AS tag, CASE WHEN doc_id % 2 = 0 THEN lang || '-' || source ELSE ' ' END AS name FROM documents)
SELECT tag, coalesce(min(CASE WHEN trim(name) <> '' THEN name END), tag) AS display_name FROM t GROUP BY tag""")
def language_options(spark, folder):
    d = table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("-"), "source")).otherwise(" ").alias("name"),
    )
    return L.language_options(d, "lang", "name")


@query("language_options_sorted", """WITH t AS (SELECT lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) ELSE lang END)) || '-' || source AS tag,
  CASE WHEN doc_id % 2 = 0 THEN upper(source) || lang ELSE ' ' END AS name FROM documents),
o AS (SELECT tag, coalesce(min(CASE WHEN trim(name) <> '' THEN name END), tag) AS display_name FROM t GROUP BY tag)
SELECT tag, display_name, row_number() OVER (ORDER BY lower(display_name), tag) AS place FROM o""")
def language_options_sorted(spark, folder):
    """Every language and source as an option, in caseless order of the display names."""
    d = table(spark, folder, "documents").select(
        F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang")), F.lit("-"), "source").alias("lang"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("source"), "lang")).otherwise(" ").alias("name"),
    )
    return L.sorted_options(L.language_options(d, "lang", "name"))


@query("language_filter", """SELECT doc_id, trim(q) = '' OR contains(lower(source), lower(trim(q))) OR contains(lower(lang), lower(trim(q))) AS shown
FROM (SELECT doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' SRC1 ' WHEN 2 THEN 'E' ELSE 'zz' END AS q FROM documents)""")
def language_filter(spark, folder):
    m = F.col("doc_id") % 4
    q = F.when(m == 0, "  ").when(m == 1, " SRC1 ").when(m == 2, "E").otherwise("zz")
    return table(spark, folder, "documents").select("doc_id", L.matches_language(q, F.col("source"), F.col("lang")).alias("shown"))


@query("default_language", """WITH t AS (SELECT DISTINCT lang FROM documents) SELECT lang AS tag FROM t WHERE lang <> 'de' ORDER BY lang = 'id' DESC, lang LIMIT 1""")
def default_language(spark, folder):
    options = L.language_options(table(spark, folder, "documents"), "lang")
    return L.default_language(options, "id", exclude="de").select("tag")


_PAIRS = """r AS (SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 5 = 0 THEN ' ' || upper(d.lang) || ' ' ELSE d.lang END AS source, CASE d.doc_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'xx' WHEN 2 THEN ' ' ELSE 'fr' END AS target FROM documents d),
n AS (SELECT doc_id, text, nullif(lower(trim(source)), '') AS s, nullif(lower(trim(target)), '') AS t FROM r),
ok AS (SELECT *, coalesce(s IN (SELECT lang FROM documents) AND t IN (SELECT lang FROM documents), false) AS pair_ok FROM n)"""


@query("language_pairs", f"""WITH {_PAIRS} SELECT doc_id, s AS source_tag, t AS target_tag, pair_ok, CASE WHEN NOT pair_ok THEN 'REJECT' WHEN doc_id % 7 = 0 THEN 'EMPTY' WHEN s = t THEN 'IDENTITY' WHEN doc_id % 3 = 0 THEN 'NOT_READY' ELSE 'TRANSLATE' END AS action FROM ok""")
def language_pairs(spark, folder):
    d = table(spark, folder, "documents")
    m = F.col("doc_id") % 4
    requests = d.select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "\t ").otherwise(F.col("lang")).alias("body"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).otherwise(F.col("lang")).alias("source"),
        F.when(m == 0, "EN").when(m == 1, "xx").when(m == 2, " ").otherwise("fr").alias("target"),
    )
    rows = L.valid_pairs(requests, d.select(F.col("lang").alias("tag")), "source", "target")
    action = L.translation_action(F.col("body"), F.col("source_tag"), F.col("target_tag"), F.col("pair_ok"), F.col("doc_id") % 3 != 0)
    return rows.select("doc_id", "source_tag", "target_tag", "pair_ok", action.alias("action"))


@query("translated_rows", f"""WITH {_PAIRS} SELECT doc_id, CASE WHEN NOT pair_ok THEN NULL WHEN s = t THEN text ELSE reverse(s) || ':' || t END AS translated, CASE WHEN NOT pair_ok THEN '{X.UNSUPPORTED_PAIR}' END AS error FROM ok""")
def translated_rows(spark, folder):
    """A toy translator (the language pair) behind the guards; identical languages pass text through."""
    d = table(spark, folder, "documents")
    m = F.col("doc_id") % 4
    requests = d.select(
        "doc_id", "text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).otherwise(F.col("lang")).alias("source"),
        F.when(m == 0, "EN").when(m == 1, "xx").when(m == 2, " ").otherwise("fr").alias("target"),
    )
    rows = L.valid_pairs(requests, d.select(F.col("lang").alias("tag")), "source", "target")
    rows = rows.withColumn("action", L.translation_action(F.col("text"), F.col("source_tag"), F.col("target_tag"), F.col("pair_ok"), F.lit(True)))
    done = L.translate(rows, lambda _: F.concat(F.reverse("source_tag"), F.lit(":"), F.col("target_tag")))
    return done.select("doc_id", "translated", "error")


@query("provider_kinds", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ML_KIT_PLAY_SERVICES' WHEN 1 THEN 'LOCAL_OPUS_ONNX' ELSE 'UNAVAILABLE' END AS provider, o_orderpriority || ' → ' || o_orderstatus AS pair FROM orders""")
def provider_kinds(spark, folder):
    m = F.col("o_orderkey") % 4
    stored = F.when(m == 0, "ML_KIT_PLAY_SERVICES").when(m == 1, "LOCAL_OPUS_ONNX").when(m == 2, "cloud").otherwise("UNAVAILABLE")
    return table(spark, folder, "orders").select("o_orderkey", L.provider_kind(stored).alias("provider"), T.language_pair_label(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("pair"))


@query("block_translate_guard", f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS s, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE 'xx' END AS t, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, CASE WHEN trim(s) = '' THEN '{X.LANGUAGES_REQUIRED}' WHEN len(lines) > 64 THEN '{X.TOO_MANY_BLOCKS}' END AS error,
  len(CASE WHEN lower(s) = lower(t) THEN lines ELSE list_filter(lines, lambda l: {sql_trim('l')} <> '') END) AS n_blocks FROM b""")
def block_translate_guard(spark, folder):
    """Lines of a document as its layout blocks."""
    d = documents(spark, folder).select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang")).alias("s"),
        F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise("xx").alias("t"),
        F.transform(F.split("text", "\n"), lambda l: F.struct(l.alias("text"))).alias("blocks"),
    )
    return plain(d.select(
        "doc_id", L.blocks_error(F.col("blocks"), F.col("s"), F.col("t")).alias("error"),
        F.size(L.blocks_to_translate(F.col("blocks"), F.col("s"), F.col("t"))).alias("n_blocks"),
    ))


@query("shown_translation", f"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN ' ' || text || chr(10) WHEN turn % 3 = 1 THEN 'other' END AS direct_source, CASE WHEN conv_id % 2 = 0 THEN ['', ' '] ELSE ['', 'one', 'two '] END AS blocks FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(array_to_string(blocks, ' ')) <> '' THEN trim(array_to_string(blocks, ' ')) WHEN {sql_trim('direct_source')} = {sql_trim('text')} THEN 'direct' ELSE '' END AS shown FROM c""")
def shown_translation(spark, folder):
    t = F.col("turn") % 3
    blocks = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(F.array(F.lit(""), F.lit("one"), F.lit("two ")))
    direct = F.when(t == 0, F.concat(F.lit(" "), "text", F.lit("\n"))).when(t == 1, F.lit("other"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", L.shown_translation(F.col("text"), blocks, direct, F.lit(" direct")).alias("shown")
    )


@query("transcripts", f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Partial' ELSE 'Final' END AS kind, {sql_trim('text')} AS text FROM conversations WHERE turn % 4 <> 3""")
def transcripts(spark, folder):
    text = F.when(F.col("turn") % 4 == 3, "\n ").otherwise(F.concat(F.lit("  "), "text", F.lit("\t")))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", L.transcript_row(text, F.col("role") == "user").alias("r"))
    return rows.where(F.col("r").isNotNull()).select("conv_id", "turn", F.col("r.kind").alias("kind"), F.col("r.text").alias("text"))


# Geometry: an order line is a box on a 640 x 480 image ------------------------------------------

_BOX = """b AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 700 - 30 AS DOUBLE) AS l, CAST(l_suppkey % 500 - 10 AS DOUBLE) AS t, CAST(l_partkey % 700 - 30 AS DOUBLE) + l_quantity - 5 AS r, CAST(l_suppkey % 500 - 10 AS DOUBLE) + l_quantity * 2 - 9 AS bt FROM lineitem),
s AS (SELECT *, greatest(1080 / 640.0::DOUBLE, 1920 / 480.0::DOUBLE) AS k FROM b),
o AS (SELECT *, l * k + (1080 - 640 * k) / 2 AS x0, r * k + (1080 - 640 * k) / 2 AS x1, t * k + (1920 - 480 * k) / 2 AS y0, bt * k + (1920 - 480 * k) / 2 AS y1 FROM s)"""


def _boxes(spark, folder):
    left, top = (F.col("l_partkey") % 700 - 30).cast("double"), (F.col("l_suppkey") % 500 - 10).cast("double")
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
        F.struct(left.alias("left"), top.alias("top"), (left + q - 5).alias("right"), (top + q * 2 - 9).alias("bottom")).alias("box"),
    )


def _sizes():
    return [F.lit(float(v)) for v in (1080, 1920, 640, 480)]


@query("ocr_overlay", f"""WITH {_BOX}, c AS (SELECT *, least(greatest(x0, 0), 1080) AS cl, least(greatest(x1, 0), 1080) AS cr, least(greatest(y0, 0), 1920) AS ct, least(greatest(y1, 0), 1920) AS cb FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cl, 6) AS box_left, round(ct, 6) AS box_top, round(cr - cl, 6) AS width, round(cb - ct, 6) AS height FROM c WHERE cr > cl AND cb > ct""")
def ocr_overlay(spark, folder):
    rows = _boxes(spark, folder).withColumn("o", G.overlay_box(F.col("box"), *_sizes())).where(F.col("o").isNotNull())
    return plain(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o.left").alias("box_left"), F.col("o.top").alias("box_top"), F.col("o.width").alias("width"), F.col("o.height").alias("height")))


@query("label_anchor", f"""WITH {_BOX} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(x0 + 0.5) AS BIGINT) AS x, CAST(floor(y0 + 0.5) AS BIGINT) AS y FROM o""")
def label_anchor(spark, folder):
    rows = _boxes(spark, folder).withColumn("a", G.label_anchor(F.col("box"), *_sizes()))
    return plain(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("a.x").alias("x"), F.col("a.y").alias("y")))


@query("image_sizes", """WITH i AS (SELECT p_partkey, CAST(p_partkey * 13 % 9000 - 50 AS BIGINT) AS w, CAST(p_partkey * 7 % 6000 AS BIGINT) AS h, p_size % 9 AS o FROM part)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN CAST(CASE WHEN w // 1 <= 1600 AND h // 1 <= 1600 THEN 1 WHEN w // 2 <= 1600 AND h // 2 <= 1600 THEN 2 WHEN w // 4 <= 1600 AND h // 4 <= 1600 THEN 4 ELSE 8 END AS BIGINT) END AS sample,
  CASE WHEN o IN (5, 6, 7, 8) THEN greatest(h, 0) ELSE greatest(w, 0) END AS width, CASE WHEN o IN (5, 6, 7, 8) THEN greatest(w, 0) ELSE greatest(h, 0) END AS height,
  CASE WHEN p_partkey % 5 = 0 THEN 'CHINESE' WHEN p_partkey % 5 = 1 THEN 'JAPANESE' WHEN p_partkey % 5 = 2 THEN 'KOREAN' ELSE 'LATIN' END AS script FROM i""")
def image_sizes(spark, folder):
    k = F.col("p_partkey")
    w, h = k * 13 % 9000 - 50, k * 7 % 6000
    tag = F.when(k % 5 == 0, "zh-TW").when(k % 5 == 1, "JA").when(k % 5 == 2, "ko").when(k % 5 == 3, "zh-hk").otherwise("en")
    rows = table(spark, folder, "part").select(
        "p_partkey", G.sample_size(w, h).alias("sample"), G.oriented_size(w, h, F.col("p_size") % 9).alias("s"), G.recognizer(tag).alias("script")
    )
    return plain(rows.select("p_partkey", "sample", F.col("s.width").alias("width"), F.col("s.height").alias("height"), "script"))


@query("ocr_lines", f"""WITH b AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line, unnest(range(len(string_split(text, '. ')))) AS i FROM conversations)
SELECT conv_id, turn, count(*) AS n_lines, CAST(sum(len(line)) AS BIGINT) AS lefts, string_agg(line, '|' ORDER BY i) AS body FROM b WHERE (len(line) + i) % 3 <> 0 GROUP BY ALL""")
def ocr_lines(spark, folder):
    """Sentences of a turn as the lines of two layout blocks; some lines have no box."""
    line = F.transform(F.split("text", "\\. "), lambda x, i: F.struct(x.alias("text"), F.when((F.length(x) + i) % 3 != 0, F.struct(
        F.length(x).cast("float").alias("left"), i.cast("float").alias("top"), F.lit(1.0).alias("right"), F.lit(1.0).alias("bottom")
    )).alias("box")))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", line.alias("l"))
    halves = F.array(F.struct(F.slice("l", 1, 2).alias("lines")), F.struct(F.slice("l", F.lit(3), F.greatest(F.size("l"), F.lit(1))).alias("lines")))
    lines = rows.select("conv_id", "turn", G.recognised_lines(halves).alias("x")).where(F.size("x") > 0)
    return plain(lines.select(
        "conv_id", "turn", F.size("x").alias("n_lines"),
        F.aggregate("x", F.lit(0.0), lambda a, e: a + e["left"].cast("double")).cast("bigint").alias("lefts"),
        F.array_join(F.transform("x", lambda e: e["text"]), "|").alias("body"),
    ))
