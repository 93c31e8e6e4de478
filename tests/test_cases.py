"""Literal cases with known answers, one operator each."""

from __future__ import annotations

import math

import pytest
from helpers import one
from pyspark.sql import functions as F

from ragspark.functions import audio as A
from ragspark.functions import prompts as P
from ragspark.functions import text as T
from ragspark.functions import urls as U
from ragspark.functions import vectors as V
from ragspark.operators import catalog as C
from ragspark.operators import chunking as K
from ragspark.operators import embedding as M
from ragspark.operators import evidence as E
from ragspark.operators import transfer as TR
from ragspark.operators import translation as L
from ragspark.operators.ordered import Ordering
from ragspark.operators.search import check_k, check_vector
from ragspark.operators.wordpiece import WordPiece


def test_six_hundred_tokens_make_two_overlapping_chunks(spark):
    text = " ".join(str(i) for i in range(600))
    rows = K.chunk_text(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start_token, r.end_token) for r in rows] == [(0, 0, 512), (1, 462, 600)]
    assert rows[1].text == " ".join(str(i) for i in range(462, 600))


@pytest.mark.parametrize("n, expected", [(0, 0), (1, 1), (49, 1), (512, 1), (513, 2), (974, 2), (975, 3)])
def test_chunk_counts_at_the_edges(spark, n, expected):
    docs = spark.createDataFrame([("d", " ".join(["x"] * n) + " \n")], "document_id string, text string")
    assert K.chunk_text(docs).count() == expected
    assert one(spark, n=K.chunk_count(F.lit(n))).n == expected


def test_window_arguments_are_checked(spark):
    docs = spark.createDataFrame([("d", "x")], "document_id string, text string")
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            K.chunk_text(docs, size=size, overlap=overlap)


def test_long_runs_are_split(spark):
    assert one(spark, t=T.tokens(F.lit("abcdefghij value"), 4)).t == ["abcd", "efgh", "ij", "valu", "e"]


def test_whitespace_set(spark):
    text = "a b　c d\u0085e\x1cf\tg"
    assert one(spark, t=T.tokens(F.lit(text))).t == ["a", "b", "c", "d\u0085e", "f", "g"]
    assert one(spark, t=T.trim_all(F.lit(" 　 x  \x1f"))).t == "x"


TOY = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "world"])}


def test_wordpiece_windows_keep_every_word(spark):
    df = spark.createDataFrame([("hello world hello world hello",)], "text string")
    windows = WordPiece(spark, TOY).windows(df, max_length=5).first().windows
    assert [w.input_ids for w in windows] == [[2, 4, 5, 4, 3], [2, 5, 4, 3, 0]]
    assert [sum(w.attention_mask) for w in windows] == [5, 4]


def test_window_rows_equal_the_window_array(spark):
    pieces = WordPiece(spark, TOY)
    df = spark.createDataFrame([(0, "hello world hello world hello"), (1, ""), (2, "world " * 9)], "k int, text string")
    rows = pieces.window_rows(df, max_length=5).orderBy("k", "window_no").collect()
    flat = [(r.k, i, w) for r in pieces.windows(df, max_length=5).orderBy("k").collect() for i, w in enumerate(r.windows)]
    assert [(r.k, r.window_no, r.input_ids, r.attention_mask, r.token_type_ids) for r in rows] == [(k, i, *w) for k, i, w in flat]


def test_wordpiece_rules(spark):
    vocabulary = {**TOY, "un": 6, "##known": 7}
    df = spark.createDataFrame([("Unknown hello! zzz " + "h" * 101,), ("",), ("hello",)], "text string")
    rows = [r.i for r in df.select(WordPiece(spark, vocabulary).ids(F.col("text")).alias("i")).collect()]
    assert rows == [[6, 7, 4, 1, 1, 1], [], [4]]
    with pytest.raises(ValueError):
        WordPiece(spark, {"a": 0})


def test_single_window_never_truncates(spark):
    ids = F.array(*[F.lit(i) for i in (4, 5, 4, 5)])
    with pytest.raises(Exception, match="exceeds one window"):
        one(spark, w=K.single_window(K.id_windows(ids, 2, 3, 0, 5)))
    assert one(spark, w=K.single_window(K.id_windows(F.array().cast("array<int>"), 2, 3, 0, 5))).w.input_ids == [2, 3, 0, 0, 0]


def test_weighted_mean_of_windows(spark):
    rows = [("a", [1.0, 0.0], 3), ("a", [0.0, 1.0], 1), ("b", [1.0, 0.0], 2), ("b", [0.0, 1.0], 1), ("z", [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "k string, embedding array<float>, weight int")
    got = {r.k: r.embedding for r in M.weighted_mean(df, ["k"], 2).collect()}
    assert got["a"] == pytest.approx([0.94868, 0.31623], abs=1e-5)
    assert got["b"] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)], abs=1e-6)
    assert got["z"] is None


@pytest.mark.parametrize("vector, weight", [([1.0, float("nan")], 1), ([1.0], 1), ([1.0, 0.0], 0)])
def test_weighted_mean_refuses_bad_windows(spark, vector, weight):
    df = spark.createDataFrame([("a", vector, weight)], "k string, embedding array<float>, weight int")
    with pytest.raises(Exception, match="invalid window"):
        M.weighted_mean(df, ["k"], 2).collect()


def test_cosine_guards(spark):
    def vec(*xs):
        return F.array(*[F.lit(float(x)).cast("float") for x in xs])

    row = one(
        spark, same=V.cosine(vec(1, 2), vec(2, 4)), zero=V.cosine(vec(0, 0), vec(1, 1)), size=V.cosine(vec(1), vec(1, 1)),
        nan=V.cosine(vec(1, float("nan")), vec(1, 1)), inf=V.cosine(vec(1, float("inf")), vec(1, 1)), lit=V.cosine_to(vec(3, 4), [3.0, 4.0]),
        dead=V.cosine_to(vec(3, 4), [0.0, 0.0]),
    )
    assert (row.same, row.zero, row.size, row.nan, row.inf, row.lit, row.dead) == (1.0, -1.0, -1.0, -1.0, -1.0, 1.0, -1.0)


def test_search_arguments():
    for k in (0, 51):
        with pytest.raises(ValueError):
            check_k(k)
    with pytest.raises(ValueError):
        check_vector([1.0, float("nan")], 2)
    with pytest.raises(ValueError):
        check_vector([1.0], 2)


HIT = "q int, document_id string, document_name string, ordinal int, text string, score float, rank int"


def _context(spark, rows, **options):
    hits = spark.createDataFrame(rows, HIT)
    asked = hits.select("q").distinct()
    return E.with_status(asked, E.build_context(hits, ["q"], **options), ["q"]).first()


def test_low_scores_are_a_miss_and_nan_is_not_relevant(spark):
    rows = [(1, "d", "n", 0, "text", 0.1, 1), (1, "d", "n", 1, "text", float("nan"), 2)]
    assert _context(spark, rows).status == "NO_EVIDENCE"


def test_a_header_that_cannot_fit_is_a_budget_failure(spark):
    row = _context(spark, [(1, "d", "n" * 10_000, 0, "text", 0.9, 1)])
    assert (row.status, row.context) == ("BUDGET_EXCEEDED", None)


def test_a_header_that_does_not_fit_is_skipped_not_terminal(spark):
    rows = [(1, "a", "x", 0, "A" * 50, 0.9, 1), (1, "b", "y" * 200, 0, "B", 0.8, 2), (1, "c", "z", 0, "C" * 500, 0.7, 3)]
    row = _context(spark, rows, max_chars=150)
    head_a, head_c = "[local:a:0] x#0\n", "[local:c:0] z#0\n"
    rest = 150 - len(head_a) - 50 - 2 - len(head_c)
    assert row.context == head_a + "A" * 50 + "\n\n" + head_c + "C" * rest
    assert (row.used_chars, len(row.context)) == (150, 150)


def test_threshold_is_inclusive_in_float32(spark):
    assert _context(spark, [(1, "d", "n", 0, "text", 0.35, 1)]).status == "OK"


def _bind(spark, answer, ids):
    cites = F.array(*[F.struct(F.lit(i).alias("source_id")) for i in ids]) if ids else F.array().cast("array<struct<source_id:string>>")
    b = one(spark, b=E.bind_citations(F.lit(answer), cites)).b
    return b.status, [c.source_id for c in b.kept]


def test_citation_binding(spark):
    assert _bind(spark, "x", []) == ("PASS", [])
    assert _bind(spark, "x [a]", [" "]) == ("NO_STABLE_IDS", [])
    assert _bind(spark, "x", ["a"]) == ("NO_CITATION", [])
    assert _bind(spark, "x [nope]", ["a"]) == ("UNKNOWN_CITATION", [])
    assert _bind(spark, "x [b] [b]", ["a", "b"]) == ("BOUND", ["b"])


def _route(spark, rag, web, status, hits):
    r = one(spark, r=E.route(F.lit(rag), F.lit(web), F.lit(status), F.lit(hits))).r
    return r.route, r.web_called


def test_routing_table(spark):
    assert _route(spark, True, True, "OK", 0) == ("LOCAL", False)
    assert _route(spark, True, True, "NO_EVIDENCE", 1) == ("WEB", True)
    assert _route(spark, True, False, "NO_EVIDENCE", 1) == ("WITHHELD", False)
    assert _route(spark, True, True, "NO_EVIDENCE", 0) == ("FAILED", True)
    assert _route(spark, True, True, "BUDGET_EXCEEDED", 1) == ("FAILED", False)
    assert _route(spark, False, True, "NO_EVIDENCE", 1) == ("WEB", True)
    assert _route(spark, False, False, "NO_EVIDENCE", 0) == ("NO_CONTEXT", False)


def test_web_context_marks_untrusted_text(spark):
    item = F.struct(F.lit("").alias("source_id"), F.lit("T").alias("title"), F.lit("https://u").alias("url"), F.lit("body").alias("content"))
    text = one(spark, c=E.web_context(F.array(item, item))).c
    assert text.startswith("[web:1] T\nURL: https://u\nREFERENCE DATA (untrusted")
    assert "\n\n[web:2] T" in text


GRID = [
    (0, 100, 200, None, 100, "APPEND", 100), (40, 100, 200, None, 100, "RESTART", None), (40, 100, 206, "bytes 40-79/100", 40, "APPEND", 40),
    (0, 100, 206, "bytes 0-39/100", 40, "APPEND", 40), (20, 100, 503, None, -1, "RETRY", None), (40, 100, 206, "bytes 41-79/100", 39, "FATAL", None),
    (40, 100, 206, "bytes 40-79/*", 40, "FATAL", None), (0, 100, 200, None, 101, "FATAL", None), (0, 100, 200, None, 99, "RETRY", None),
    (0, 100, 200, None, -1, "APPEND", 100), (100, 100, 206, None, -1, "FATAL", None), (0, 0, 200, None, -1, "FATAL", None),
    (0, 100, 404, None, -1, "FATAL", None), (0, 100, 599, None, -1, "RETRY", None), (40, 100, 206, "bytes 40-100/100", -1, "FATAL", None),
]


def test_response_planning(spark):
    rows = [(i, o, t, c, r, n) for i, (o, t, c, r, n, *_) in enumerate(GRID)]
    df = spark.createDataFrame(rows, "i int, o long, t long, c int, r string, n long")
    planned = TR.plan_responses(df, F.col("o"), F.col("t"), F.col("c"), F.col("r"), F.col("n")).orderBy("i").collect()
    assert [(p.plan, p.expected_bytes) for p in planned] == [(g[5], g[6]) for g in GRID]
    assert planned[5].error == "Content-Range starts at 41, expected 40"
    assert planned[4].error == "Model server returned HTTP 503"


def test_body_length(spark):
    row = one(spark, a=TR.body_check(F.lit(60), F.lit(59)), b=TR.body_check(F.lit(60), F.lit(60)), c=TR.body_check(F.lit(60), F.lit(61)))
    assert (row.a, row.b, row.c) == ("RETRY", "OK", "FATAL")


def test_transfer_completes(spark):
    actions = [("start", 0), ("progress", 100), ("verify", 0), ("verified", 0)]
    df = spark.createDataFrame([("k", i, 0, a, b, 100) for i, (a, b) in enumerate(actions)], "k string, i long, _bucket long, action string, bytes long, total_bytes long")
    states = [r.state for r in TR.reduce_transfers(df, Ordering(("k",), ("i",))).orderBy("i").collect()]
    assert states == ["Downloading", "Downloading", "Verifying", "Complete"]


def test_pause_survives_a_late_progress_update(spark):
    rows = [("k", 0, 0, "update", "Downloading", 256), ("k", 1, 0, "pause", None, None), ("k", 2, 0, "update", "Downloading", 512)]
    df = spark.createDataFrame(rows, "k string, i long, _bucket long, kind string, status string, downloaded long")
    out = TR.pause_fence(df, Ordering(("k",), ("i",))).orderBy("i").collect()
    assert [(r.applied, r.new_status, r.new_downloaded) for r in out] == [(True, "Downloading", 256), (True, "Paused", 256), (False, None, None)]


def test_work_in_flight_is_paused_after_a_restart(spark):
    def recover(status, stored="f", downloaded=128):
        r = one(spark, s=TR.recover_status(F.lit(status), F.lit(stored), F.lit("f"), F.lit(downloaded).cast("bigint"), F.lit(1000).cast("bigint"), F.lit(1000).cast("bigint"), F.lit("SAF_PERSISTENT"), F.lit(" "))).s
        return r.status, r.downloaded

    assert recover("downloading") == ("Paused", 128)
    assert recover("downloading", stored="old") == ("NotInstalled", None)
    assert recover("verifying", downloaded=2000) == ("NotInstalled", None)
    assert recover("error") == ("NotInstalled", None)


@pytest.mark.parametrize("n, label", [
    (231508, "231.5 KB"), (2841481184, "2.8 GB"), (-5, "0 B"), (999, "999 B"), (1000, "1 KB"), (1250, "1.3 KB"), (999_950, "1000 KB"), (23026053, "23 MB"),
])
def test_byte_labels(spark, n, label):
    assert one(spark, s=T.format_bytes(F.lit(n).cast("bigint"))).s == label


def test_audio(spark):
    def frame(v):
        return F.array_repeat(F.lit(v).cast("smallint"), 320)

    row = one(spark, zero=A.rms(frame(0)), full=A.rms(frame(32767)), none=A.rms(F.array().cast("array<smallint>")), t=A.read_state(F.lit(-6)), e=A.read_state(F.lit(0)))
    assert (row.zero, row.none, row.t, row.e) == (0.0, 0.0, "TERMINAL", "EMPTY")
    assert 0.99 < row.full <= 1.0


@pytest.mark.parametrize("url, safe, trusted", [
    ("https://en.wikipedia.org/wiki/X", True, True), ("http://en.wikipedia.org/wiki/X", False, False), ("https://EN.wikipedia.org/a", True, True),
    ("https://en.wikipedia.org.evil.example/a", True, False), ("https://user:pw@en.wikipedia.org/a", False, False), ("not a url", False, False), ("https:///x", False, False),
])
def test_url_rules(spark, url, safe, trusted):
    row = one(spark, s=U.is_safe_https(F.lit(url)), t=U.is_trusted_host(F.lit(url)))
    assert (row.s, row.t) == (safe, trusted)


def test_persona_rules_first_failure_wins(spark):
    row = one(spark, a=C.persona_error(F.lit(" "), F.lit("p"), F.lit(0.7), F.lit(0.9), F.lit(128)), b=C.persona_error(F.lit("n"), F.lit("p"), F.lit(0.7), F.lit(0.9), F.lit(128)),
              c=C.persona_error(F.lit("n"), F.lit("p"), F.lit(0.7), F.lit(0.9), F.lit(2048)), d=C.persona_error(F.lit("n"), F.lit("p"), F.lit(float("nan")), F.lit(0.9), F.lit(2048)))
    assert row.a == "Persona name is required"
    assert row.b == "Max tokens must be between 256 and 4096"
    assert row.c is None
    assert row.d == "Temperature must be between 0.1 and 1.0"


def test_one_active_persona(spark):
    schema = "owner int, persona_id string, name string, active boolean"
    people = spark.createDataFrame([(1, "a", "A", True), (1, "b", "B", False)], schema)
    saved = C.save_active(people, spark.createDataFrame([(1, "c", "C", False)], schema), "owner").collect()
    assert sorted((r.persona_id, r.active) for r in saved) == [("a", False), ("b", False), ("c", True)]
    missing = spark.createDataFrame([(1, "zz")], "owner int, persona_id string")
    assert sorted((r.persona_id, r.active) for r in C.set_active(people, missing, "owner").collect()) == [("a", True), ("b", False)]


def test_language_filter(spark):
    df = spark.createDataFrame([("en", "English"), ("id", "Indonesian"), ("ja", "Japanese")], "tag string, name string")
    assert [r.tag for r in df.where(L.matches_language(F.lit(" indo"), F.col("name"), F.col("tag"))).collect()] == ["id"]


def test_markers_are_escaped(spark):
    assert one(spark, t=P.escape_markers(F.lit("a<|turn>b</s>c<bos>"))).t == "a< |turn >b< /s >c< bos >"


def test_file_names(spark):
    row = one(spark, a=T.safe_file_name(F.lit("https://x/a%2Fb c.GGUF"), F.lit("f b")), b=T.safe_file_name(F.lit("https://x/..."), F.lit("f b")), c=T.safe_file_name(F.lit(None).cast("string"), F.lit("f b")),
              d=T.file_extension(F.lit("a.tar.G-Z")), e=T.file_extension(F.lit("none")))
    assert (row.a, row.b, row.c, row.d, row.e) == ("b_c.GGUF", "f_b", "f_b", "gz", "bin")


def test_boundaries_fail_closed(spark):
    with pytest.raises(M.BoundaryUnavailable):
        M.with_embedding(spark.range(1).select(F.lit("x").alias("text")), M.Unavailable("embedding"))


def test_stand_in_vectors_are_unit_length(spark):
    df = spark.createDataFrame([("Hello, hello world",), ("  ",)], "text string")
    rows = M.with_embedding(df, M.HashedBagOfWords(16)).collect()
    assert sum(x * x for x in rows[0].embedding) == pytest.approx(1.0, abs=1e-6)
    assert rows[1].embedding is None


def test_wordpiece_ids_do_not_depend_on_the_block():
    import pyarrow as pa

    from ragspark.operators.embedding import token_blocks
    from ragspark.operators.wordpiece import Pieces, _ids_of

    pieces = Pieces({**TOY, "un": 6, "##known": 7}, 1)
    words = pa.array([["unknown", "hello"], None, [], ["zzz"], ["world", "unknown", "un"]], pa.list_(pa.string()))
    whole = [[6, 7, 4], [], [], [1], [5, 6, 7, 6]]
    assert pa.concat_arrays([_ids_of(p, pieces) for p in token_blocks(words, 2)]).to_pylist() == whole == _ids_of(words, pieces).to_pylist()


def test_unit_vectors_sum_the_norm_once(spark):
    from ragspark.functions import vectors as V

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("inf"), 1.0],), ([],)], "v array<double>")
    unit = df.select(V.l2_normalise(F.col("v")).alias("u"))
    assert [r.u and [round(x, 6) for x in r.u] for r in unit.collect()] == [[0.6, 0.8], None, None, None, None]
    plan = unit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_language_guards_do_not_shuffle_requests(spark):
    from ragspark.operators import translation as L

    rows = spark.range(100).select("id", F.lit(" EN ").alias("a"), F.when(F.col("id") % 2 == 0, "fr").when(F.col("id") % 5 == 0, "xx").alias("b"))
    pairs = L.valid_pairs(rows, spark.createDataFrame([("en",), ("FR",), ("en",)], "tag string"), "a", "b")
    assert "Exchange hashpartitioning(source_tag" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in pairs.where("pair_ok").orderBy("id").collect()] == list(range(0, 100, 2)) and pairs.count() == 100
