"""Conversation history, prompts, and web evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import fixed as X
from ragspark.functions import prompts as P
from ragspark.functions import urls as U
from ragspark.operators import evidence as E
from ragspark.operators import history as H
from ragspark.operators import web as W
from ragspark.queries.registry import plain, query, sql_trim, table

_T = sql_trim("text")


def _turns(spark, folder):
    return table(spark, folder, "conversations")


@query("history_last_n", """SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""")
def history_last_n(spark, folder):
    return H.last_messages(_turns(spark, folder), ["conv_id"], "turn", 4).select("conv_id", "turn", "role")


@query("history_default", """SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8""")
def history_default(spark, folder):
    return H.last_messages(_turns(spark, folder), ["conv_id"], "turn").select("conv_id", "turn", "role")


def _sql_budget(n: int, each: int, total: int, order: str) -> str:
    return f"""r AS (SELECT conv_id, turn, role, {_T} AS c FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}),
cap AS (SELECT *, least({each}, len(c)) AS cap FROM r),
t AS (SELECT conv_id, turn, role, c, greatest(0, least(cap, {total} - coalesce(sum(cap) OVER (PARTITION BY conv_id ORDER BY turn {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM cap),
b AS (SELECT conv_id, turn, role, CAST(taken AS BIGINT) AS taken, substr(c, 1, CAST(taken AS BIGINT)) AS excerpt FROM t WHERE taken > 0)"""


@query("history_budget", f"WITH {_sql_budget(8, 400, 1500, 'ASC')} SELECT conv_id, turn, taken, excerpt FROM b")
def history_budget(spark, folder):
    rows = H.budget(_turns(spark, folder), ["conv_id"], "turn", total=1500, each=400)
    return plain(rows.select("conv_id", "turn", "taken", "excerpt"))


@query("history_budget_newest", f"WITH {_sql_budget(8, 400, 1500, 'DESC')} SELECT conv_id, turn, taken, excerpt FROM b")
def history_budget_newest(spark, folder):
    rows = H.budget(_turns(spark, folder), ["conv_id"], "turn", total=1500, each=400, newest_first=True)
    return plain(rows.select("conv_id", "turn", "taken", "excerpt"))


@query("history_budget_default", f"WITH {_sql_budget(8, 1500, 6000, 'ASC')} SELECT conv_id, turn, taken, excerpt FROM b")
def history_budget_default(spark, folder):
    return plain(H.budget(_turns(spark, folder), ["conv_id"], "turn").select("conv_id", "turn", "taken", "excerpt"))


@query("user_prompt", f"""WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
conv AS (SELECT c.* FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn < l.turn),
{_sql_budget(8, 1500, 6000, 'ASC').replace('FROM conversations', 'FROM conv')},
h AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || excerpt || chr(10), '' ORDER BY turn) AS lines FROM b GROUP BY conv_id)
SELECT l.conv_id, CASE WHEN h.lines IS NOT NULL THEN '{X.HISTORY_HEADING}' || chr(10) || h.lines || chr(10) ELSE '' END || '{X.MESSAGE_HEADING}' || chr(10) || {sql_trim('c.text')} AS prompt
FROM last l JOIN conversations c USING (conv_id, turn) LEFT JOIN h USING (conv_id)""")
def user_prompt(spark, folder):
    """The last message of each conversation, with the ones before it as history."""
    turns = _turns(spark, folder)
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("message"), F.max("turn").alias("_last"))
    before = turns.join(last.select("conv_id", "_last"), "conv_id").where(F.col("turn") < F.col("_last"))
    lines = H.history_lines(H.budget(before, ["conv_id"], "turn"), ["conv_id"], "turn")
    rows = last.join(lines, "conv_id", "left")
    return rows.select("conv_id", P.user_prompt(F.col("history"), F.col("message")).alias("prompt"))


def _sql_escape(c: str) -> str:
    for m in X.CONTROL_MARKERS:
        c = f"replace({c}, '{m}', '< {m[1:-1]} >')"
    return c


@query("prompt_escape", f"""WITH m AS (SELECT conv_id, turn, replace(replace(replace(text, 'e ', 'e<|turn>'), 'n ', '</s>n<bos> '), '. ', '.<end_of_turn><turn|>') AS t FROM conversations)
SELECT conv_id, turn, {_sql_escape('t')} AS safe, '<|turn>system' || chr(10) || {_sql_escape('t')} || '<turn|>' || chr(10) || '<|turn>user' || chr(10) || 'Hi' || '<turn|>' || chr(10) || '<|turn>model' || chr(10) AS turns FROM m""")
def prompt_escape(spark, folder):
    t = F.col("text")
    for old, new in (("e ", "e<|turn>"), ("n ", "</s>n<bos> "), (". ", ".<end_of_turn><turn|>")):
        t = F.replace(t, F.lit(old), F.lit(new))
    rows = _turns(spark, folder).select("conv_id", "turn", P.escape_markers(t).alias("safe"))
    return rows.withColumn("turns", P.chat_turns(F.col("safe"), F.lit("Hi")))


@query("system_prompt", f"""SELECT conv_id, turn, {_T} || CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) || chr(10) || '{X.PERSONA_HEADING}' || chr(10) || 'Be ' || role END
 || chr(10) || chr(10) || 'POLICY' || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '{X.EVIDENCE_CLAUSE}' || chr(10) || '[local:' || conv_id || ':0]' ELSE chr(10) || chr(10) || '{X.NO_EVIDENCE_CLAUSE}' END AS prompt FROM conversations""")
def system_prompt(spark, folder):
    persona = F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.concat(F.lit("\tBe "), "role", F.lit(" ")))
    context = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[local:"), F.col("conv_id").cast("string"), F.lit(":0]")))
    return _turns(spark, folder).select(
        "conv_id", "turn", P.system_prompt(F.col("text"), persona, context, F.lit("POLICY")).alias("prompt")
    )


@query("send_guard", f"""SELECT conv_id, turn, CASE WHEN {sql_trim("CASE WHEN turn % 4 = 3 THEN ' ' || chr(160) ELSE text END")} = '' THEN 'IGNORE_BLANK' WHEN conv_id % 5 = 0 THEN 'ERROR_NO_PERSONA'
  WHEN conv_id % 5 = 1 THEN 'IGNORE_BUSY' ELSE 'SEND' END AS decision FROM conversations""")
def send_guard(spark, folder):
    text = F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.col("text"))
    return _turns(spark, folder).select(
        "conv_id", "turn", E.send_guard(text, F.col("conv_id") % 5 != 0, F.col("conv_id") % 5 == 1).alias("decision")
    )


# Web evidence from pages: title element, whole markup as the description -----------------------

_SP = r"[ \t\n\x0B\f\r]+"
_PAGES = r"""p AS (SELECT page_id, CASE WHEN page_id % 9 = 8 THEN '  ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, html,
  CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN regexp_replace(url, '//[^/]*', '//en.wikipedia.org') WHEN 2 THEN regexp_replace(url, '//[^/]*', '//EN.Wikipedia.org')
  WHEN 3 THEN regexp_replace(url, '//[^/]*', '//en.wikipedia.org.evil.example') ELSE ' ' || url || ' ' END AS url FROM pages)"""


def _pages(spark, folder):
    url, m = F.col("url"), F.col("page_id") % 6
    host = {1: "//en.wikipedia.org", 2: "//EN.Wikipedia.org", 3: "//en.wikipedia.org.evil.example"}
    link = F.when(m == 0, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
    for k, h in host.items():
        link = link.when(m == k, F.regexp_replace(url, "//[^/]*", h))
    return table(spark, folder, "pages").select(
        "page_id", F.when(F.col("page_id") % 9 == 8, "  ").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        "html", link.otherwise(F.concat(F.lit(" "), url, F.lit(" "))).alias("url"),
    )


_SAFE = "starts_with(lower({u}), 'https://') AND regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1) <> '' AND NOT contains(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1), '@')"
_HOST = "lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)) = 'en.wikipedia.org'"


@query("url_trust", f"""WITH {_PAGES} SELECT page_id, {_SAFE.format(u='trim(url)')} AS safe, {_SAFE.format(u='trim(url)')} AND {_HOST.format(u='trim(url)')} AS trusted FROM p""")
def url_trust(spark, folder):
    link = F.trim("url")
    return _pages(spark, folder).select("page_id", U.is_safe_https(link).alias("safe"), U.is_trusted_host(link).alias("trusted"))


_CLEAN = f"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{_SP}', ' ', 'g'))"
_BRAVE = f"""brave AS (SELECT page_id, substr(trim(title), 1, 240) AS title, trim(url) AS url, substr({_CLEAN}, 1, 320) AS excerpt, substr({_CLEAN}, 1, 1200) AS content,
  'Brave Search' AS provider, 'brave:' || substr(sha256(trim(url)), 1, 24) AS source_id FROM p WHERE trim(title) <> '' AND {_CLEAN} <> '' AND {_SAFE.format(u='trim(url)')})"""
_WIKI = f"""wiki AS (SELECT page_id, trim(title) AS title, trim(url) AS url, substr(regexp_replace(trim(html), '{_SP}', ' ', 'g'), 1, 320) AS excerpt, substr(trim(html), 1, 1200) AS content,
  'Wikipedia' AS provider, 'wikipedia:' || page_id AS source_id FROM p WHERE trim(title) <> '' AND {_SAFE.format(u='trim(url)')} AND {_HOST.format(u='trim(url)')})"""


@query("web_normalise", f"WITH {_PAGES}, {_BRAVE} SELECT * FROM brave")
def web_normalise(spark, folder):
    return W.search_evidence(_pages(spark, folder), "title", "html", "url", ["page_id"])


@query("encyclopedia_normalise", f"WITH {_PAGES}, {_WIKI} SELECT * FROM wiki")
def encyclopedia_normalise(spark, folder):
    rows = _pages(spark, folder).withColumn("id", F.col("page_id"))
    return W.encyclopedia_evidence(rows, "id", "title", "html", "url", ["page_id"])


@query("web_json_parse", f"WITH {_PAGES}, {_WIKI} SELECT page_id, title, url, excerpt, source_id FROM wiki")
def web_json_parse(spark, folder):
    """Pages packed as provider JSON (with keys nobody asked for) and parsed back."""
    page = F.struct(F.col("title"), F.col("html").alias("extract"), F.col("url").alias("fullurl"), F.col("page_id").alias("pageid"), F.lit(0).alias("ns"))
    body = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query"), F.lit(True).alias("batchcomplete")))
    packed = _pages(spark, folder).select("page_id", body.alias("body"))
    rows = W.parse_encyclopedia(packed, "body").withColumn("id", F.col("page_id"))
    return W.encyclopedia_evidence(rows, "id", "title", "extract", "url", ["page_id"]).select(
        "page_id", "title", "url", "excerpt", "source_id"
    )


def _bodies(spark, folder, pack):
    """Provider bodies of all pages: as packed, cut short, the bare page, an object without results, none at all, and very long."""
    m, good = F.col("page_id") % 13, F.to_json(pack)
    body = F.when(m == 3, F.substring(good, F.lit(1), F.length(good) - 1)).when(m == 5, F.col("html")).when(m == 7, "{}").when(
        m == 9, F.lit(None).cast("string")).when(m == 11, F.concat(good, F.repeat(F.lit(" "), F.lit(600_000)))).otherwise(good)
    return _pages(spark, folder).select("page_id", body.alias("body"), (F.col("page_id") * 1000).alias("at"))


_ERROR = """CASE WHEN page_id % 13 = 11 THEN 'Web response exceeded the safety limit' WHEN page_id % 13 IN (3, 5, 9) THEN '{}' END"""


@query("web_json_errors", f"""WITH {_PAGES} SELECT page_id, 'Wikipedia' AS provider, {_ERROR.format('Web search could not be completed')} AS error FROM p WHERE page_id % 13 <> 7
UNION ALL SELECT page_id, 'Brave Search', {_ERROR.format('Brave Search could not be completed')} FROM p WHERE page_id % 13 <> 7""")
def web_json_errors(spark, folder):
    """What becomes of every provider body: a result or an error, never nothing but for an object without results."""
    page = F.struct(F.col("title"), F.col("html").alias("extract"), F.col("url").alias("fullurl"), F.col("page_id").alias("pageid"))
    first = W.parse_encyclopedia(_bodies(spark, folder, F.struct(F.struct(F.array(page).alias("pages")).alias("query"))).withColumnRenamed("page_id", "id"), "body", ["id"])
    result = F.struct(F.col("title"), F.col("html").alias("description"), F.col("url"))
    second = W.parse_search(_bodies(spark, folder, F.struct(F.struct(F.array(result).alias("results")).alias("web"))), "body", ["page_id"])
    return first.select(F.col("id").alias("page_id"), F.lit("Wikipedia").alias("provider"), "error").unionByName(
        second.select("page_id", F.lit("Brave Search").alias("provider"), "error"))


@query("web_search_parse", f"WITH {_PAGES}, {_BRAVE} SELECT *, page_id * 1000 AS retrieved_ms FROM brave WHERE page_id % 13 NOT IN (3, 5, 7, 9, 11)")
def web_search_parse(spark, folder):
    """Web search bodies of all pages parsed and normalised, with the time of each answer."""
    result = F.struct(F.col("title"), F.col("html").alias("description"), F.col("url"))
    bodies = _bodies(spark, folder, F.struct(F.struct(F.array(result).alias("results")).alias("web")))
    rows = W.parse_search(bodies, "body", ["page_id", "at"])
    return W.search_evidence(rows, "title", "description", "url", ["page_id"], retrieved=F.col("at"))


@query("body_limits", f"""SELECT doc_id, strlen(text) <= 524288 AS within, strlen(text) <= 524288 AND (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE n_chars * 600 END) <= 524288 AS both_within,
  CASE WHEN len({sql_trim('text')}) NOT BETWEEN 2 AND 400 THEN 'Web search query must be between 2 and 400 characters' END AS query_error,
  least(greatest(doc_id % 9 - 2, 1), 5) AS n_results FROM documents""")
def body_limits(spark, folder):
    d = table(spark, folder, "documents")
    declared = F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("n_chars") * 600)
    return plain(d.select(
        "doc_id", W.body_within_limit(F.col("text")).alias("within"),
        W.body_within_limit(F.col("text"), declared).alias("both_within"),
        W.query_error(F.col("text")).alias("query_error"),
        W.result_limit(F.col("doc_id") % 9 - 2).alias("n_results"),
    ))


@query("source_failover", f"""WITH {_PAGES}, {_WIKI}, {_BRAVE},
w AS (SELECT page_id % 60 AS request, * FROM wiki), b AS (SELECT page_id % 60 AS request, * FROM brave)
SELECT request, page_id, provider, source_id FROM w UNION ALL SELECT request, page_id, provider, source_id FROM b WHERE request NOT IN (SELECT request FROM w)""")
def source_failover(spark, folder):
    request = (F.col("page_id") % 60).alias("request")
    cols = [request, "page_id", "provider", "source_id"]
    return W.failover(encyclopedia_normalise(spark, folder).select(*cols), web_normalise(spark, folder).select(*cols), ["request"])


@query("failover_outcomes", """WITH g AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'first failed' END AS e1, event_id % 3 AS n1, event_id % 5 < 4 AS ready,
  CASE WHEN event_id % 7 < 2 THEN 'second failed' END AS e2, event_id % 2 AS n2 FROM events),
s AS (SELECT *, NOT (e1 IS NULL AND n1 > 0) AND ready AND (CASE WHEN e2 IS NULL THEN n2 > 0 ELSE e1 IS NOT NULL END) AS second FROM g)
SELECT event_id, CASE WHEN second THEN 'SECONDARY' ELSE 'PRIMARY' END AS source, CASE WHEN second THEN e2 ELSE e1 END AS error,
  CASE WHEN event_id % 5 = 4 THEN 'NOT_CONFIGURED' WHEN e2 IS NULL THEN 'AVAILABLE' WHEN event_id % 7 = 0 THEN 'OFFLINE' ELSE 'UNAVAILABLE' END AS availability FROM s""")
def failover_outcomes(spark, folder):
    i = F.col("event_id")
    e1, e2, ready = F.when(i % 4 == 0, "first failed"), F.when(i % 7 < 2, "second failed"), i % 5 < 4
    rows = table(spark, folder, "events").select("event_id", W.failover_outcome(e1, i % 3, ready, e2, i % 2).alias("o"),
                                                 W.availability(e2, i % 7 == 0, ready).alias("availability"))
    return rows.select("event_id", F.col("o.source").alias("source"), F.col("o.error").alias("error"), "availability")


@query("provider_status", """WITH u AS (SELECT s_suppkey % 50 AS provider, max(s_name) AS detail FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT n_nationkey % 50 + 0 AS provider, coalesce(u.detail, n_name) AS detail FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation) n LEFT JOIN u ON u.provider = n_nationkey""")
def provider_status(spark, folder):
    current = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("provider"), F.col("n_name").alias("detail"))
    updates = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").groupBy((F.col("s_suppkey") % 50).alias("provider")).agg(F.max("s_name").alias("detail"))
    return W.replace_status(current, updates, "provider")


@query("web_citations", f"""WITH {_PAGES} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE 'web:' || page_id END AS source_id, title, 'Wikipedia' AS provider FROM p""")
def web_citations(spark, folder):
    sid = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.concat(F.lit("web:"), F.col("page_id").cast("string")))
    c = E.web_citation(F.col("title"), F.col("url"), F.col("html"), F.lit("Wikipedia"), sid)
    return _pages(spark, folder).withColumn("c", c).select("page_id", "c.source_id", "c.title", "c.provider")
