"""The operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from ragspark.llm import (
    attribution, components, decontaminate, kdshards, kernel, langid, linededup, lmscore, pieces, repetition, simhash,
    suffixes, toxicity,
)

WS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


# kernel ----------------------------------------------------------------------------------------


def test_span_hashes_agree_with_equality_across_pieces(monkeypatch):
    monkeypatch.setattr(kernel, "PIECE", 64)
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 3, 150]))) for _ in range(400)]
    buf, bounds = kernel.joined(words)
    h = kernel.SpanHash()(buf, bounds[:-1], bounds[1:] - 1)
    assert len(set(h.tolist())) == len(set(words))
    assert len({(a, int(b)) for a, b in zip(words, h)}) == len(set(words))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    text, cut = rng.integers(0, 3, 200), 120
    limit = np.where(np.arange(200) < cut, cut, 200)
    levels = []
    sa = suffixes.suffix_array(text, limit, levels)
    suffix = [text[i : limit[i]].tolist() for i in range(200)]
    assert [suffix[i] for i in sa] == sorted(suffix)
    i, j = sa[:-1], sa[1:]
    keep = (i < cut) & (j < cut)  # one document
    got = suffixes.common_prefix(i[keep], j[keep], levels, limit)
    want = [next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))
            for a, b in zip(i[keep], j[keep])]
    assert got.tolist() == want


# decontamination -------------------------------------------------------------------------------


def hits_by_hand(text, items, width=13):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    words, hit, found = split(text), set(), set()
    for item, phrase in items:
        p = split(phrase)
        for w in {tuple(p[i : i + width]) for i in range(max(1, len(p) - width + 1))} if p and item is not None else ():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_contamination_matches_brute_force(spark, make, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", block)
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([1, 3, 13, 20]), 6)) for i in range(12)] + [(50, None), (None, "w1 w2"), (51, "--")]
    docs = [(i, prose(rng, rng.randrange(0, 200), 6).upper()) for i in range(30)] + [(99, None), (98, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(make(docs), bench).collect()}
    assert got == {d: hits_by_hand(t, items) for d, t in docs}


def test_contamination_spans_and_odd_rows(spark, odd, make):
    bench = spark.createDataFrame([(1, "a b"), (2, "long words long")], "item_id long, text string")
    rows = decontaminate.contamination(make([(1, "é! A,  B. c")]), bench).collect()
    assert [(s.start, s.end) for s in rows[0].spans] == [(3, 8)]
    found = decontaminate.contamination(odd, bench).collect()
    assert len(found) == 10 and max(r.n_hit for r in found) == 59_999
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == 9
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(odd, none).collect()} == {0}
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


# near-dedup ------------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = re.findall(WS, lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 70):
        text = prose(rng, n)
        assert simhash.fingerprint(text.encode()) % 2**64 == fingerprint_by_hand(text)
    assert simhash.fingerprint(b" \n") == 0


def test_links_reach_every_near_fingerprint(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for k in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (x >> 63 << 64) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.label for r in components.components(simhash.fingerprint_links(frame, len(fps))).collect()}
    got = [found.get(x, x) for x in signed]
    want = classes_by_hand(fps)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_near_duplicates_and_odd_rows(odd, make):
    rng = random.Random(4)
    base = [prose(rng, 60, 500) for _ in range(5)]
    docs = [(i, base[i % 5] + (" end" if i % 3 else "")) for i in range(25)] + [(60, ""), (61, None)]
    rows = simhash.near_duplicates(make(docs)).collect()
    fps = {d: fingerprint_by_hand(t) for d, t in docs}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    order = sorted(fps)
    want = classes_by_hand([fps[d] for d in order])
    assert {r.doc_id: r.component_id for r in rows} == {d: order[w] for d, w in zip(order, want)}
    assert simhash.near_duplicates(odd).count() == 10
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4, 5, 6]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# repetition ------------------------------------------------------------------------------------


def in_repeats(words, size):
    seen = {}
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    return {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + size)}


def test_repetition_matches_brute_force(make, odd):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randrange(0, 150), rng.choice([2, 5, 40])) + "#$ é") for i in range(40)] + [(90, None)]
    for r in repetition.repetition_report(make(docs)).collect():
        text = dict(docs)[r.doc_id] or ""
        words = re.findall(WS, text)
        lines = [x for x in text.split("\n") if re.search(WS, x)]
        longest = max([0, *(k for k in range(1, len(words)) if in_repeats(words, k))])
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert (r.n_repeat_words, r.n_covered) == (len(in_repeats(words, 8)), len(in_repeats(words, 5)))
        assert r.longest_repeat == (longest if longest >= 5 else 0)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
    assert repetition.repetition_report(odd).count() == 10
    assert repetition.repetition_report(odd.limit(0)).count() == 0


# SentencePiece ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Vocabulary(pieces.read_pieces(pieces.MODEL)))


def test_viterbi_is_the_best_segmentation(codec):
    table = {}
    score = {}
    for i, (raw, s, _) in enumerate(pieces.read_pieces(pieces.MODEL)):
        score[i] = s
        if raw:
            table[raw] = max(s, table.get(raw, s))
    rng = random.Random(3)
    texts = ["the cat  sat\n\ton ▁ mats é漢字 🙂", "", " ", "a", "internationalisation" * 6, "x" * 200]
    texts += ["".join(rng.choices("thea é\n", k=rng.randrange(80))) for _ in range(40)]
    raws = [t.encode() for t in texts]
    ids, counts = codec.encode(raws)
    assert codec.decode(ids, counts) == raws
    cuts = np.cumsum([0, *counts])
    for raw, a, b in zip(raws, cuts, cuts[1:]):
        best = [0.0] + [-np.inf] * (len(raw) + 1)
        full = b" " + raw if raw else b""
        for e in range(1, len(full) + 1):
            for s in range(max(0, e - 48), e):
                if full[s:e] in table:
                    best[e] = max(best[e], best[s] + table[full[s:e]])
        assert sum(score[int(i)] for i in ids[a:b]) == pytest.approx(best[len(full)])


def test_encoding_round_trip(odd):
    encoded = pieces.encode_pieces(odd)
    rows = encoded.collect()
    assert all(r.round_trip for r in rows if r.ids is not None) and sum(r.ids is None for r in rows) == 2
    back = sorted((r.doc_id or 0, r.text or "") for r in pieces.decode_pieces(encoded).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert pieces.encode_pieces(odd.limit(0)).count() == 0


# line dedup ------------------------------------------------------------------------------------


def kept_by_hand(docs, min_docs):
    def key(line):
        return lower(line.strip(" \t\n\v\f\r"))

    where = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(d)
    often = {k for k, v in where.items() if k and len(v) >= min_docs}
    return {d: [x for x in (t or "").split("\n") if key(x) not in often] for d, t in docs}


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_line_dedup_matches_brute_force(spark, make, parts):
    rng = random.Random(int(parts))
    lines = ["Hot line", "", "  ", *(f"line {i}" for i in range(60))]
    docs = [(i, "\n".join(rng.choice(lines[: rng.choice([2, 63])]) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    docs += [(500, None), (501, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = linededup.line_report(make(docs), min_docs=10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = kept_by_hand(docs, 10)
    for r in rows:
        text = dict(docs)[r.doc_id] or ""
        kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped) == (text.count("\n") + 1, text.count("\n") + 1 - len(kept))
        assert r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup_keeps_first_occurrence_and_odd_rows(make, odd):
    docs = [(1, "a\nb\na"), (2, "A \nc"), (3, "b")]
    out = {r.doc_id: (r.text, r.n_chars) for r in linededup.line_dedup(make(docs), min_docs=1, keep_first=True).collect()}
    assert out == {1: ("a\nb", 3), 2: ("c", 1), 3: ("", 0)}
    whole = linededup.line_dedup(odd, min_docs=2)
    assert whole.columns == odd.columns and whole.count() == 10
    assert sum(r.text == "same row" for r in whole.collect()) == 2  # repeated rows are one document
    assert linededup.line_dedup(odd.limit(0)).count() == 0


# language model --------------------------------------------------------------------------------


def test_cross_entropy_difference_matches_brute_force(spark, make, odd):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(1 + rng.randrange(30))}" for _ in range(rng.randrange(1, 60)))) for i in range(40)] + [(70, None)]
    target = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(None,)], "doc_id long")
    rows = lmscore.cross_entropy_difference(make(docs), target, vocabulary=12).collect()
    count = {}
    words = {d: re.findall(WS, lower(t)) for d, t in docs}
    for w in words.values():
        for x in w:
            count[x] = count.get(x, 0) + 1
    ten = sorted(count.values(), reverse=True)[10]
    vocabulary = {x for x, n in count.items() if n > ten}
    if len(vocabulary) != 10:
        pytest.skip("a tie at the edge of the vocabulary")

    def losses(members):
        pairs, left, one = {}, {}, {x: 1 for x in [*vocabulary, "?"]}
        for d in members:
            prev = "^"
            for x in (x if x in vocabulary else "?" for x in words[d]):
                pairs[prev, x] = pairs.get((prev, x), 0) + 1
                left[prev] = left.get(prev, 0) + 1
                one[x] += 1
                prev = x
        total = sum(one.values())

        def loss(prev, x):
            kinds = len({x for a, x in pairs if a == prev})
            uni = one[x] / total
            return -np.log((pairs.get((prev, x), 0) + kinds * uni) / (left[prev] + kinds)) if prev in left else -np.log(uni)

        return loss

    for r in rows:  # each document is scored by models that do not hold it
        t, b = losses([d for d in words if d % 3 == 0 and d < 40 and d != r.doc_id]), losses([d for d in words if d != r.doc_id])
        s = [x if x in vocabulary else "?" for x in words[r.doc_id]]
        pairs = list(zip(["^", *s], s))
        want = [np.mean([f(*p) for p in pairs]) if pairs else 0.0 for f in (t, b)]
        assert (r.target_loss, r.background_loss) == pytest.approx(want, abs=1e-5)
    assert lmscore.cross_entropy_difference(odd, target).count() == 10
    assert lmscore.cross_entropy_difference(odd.limit(0), target).count() == 0


def test_cross_entropy_counts_every_word(spark, make):
    """Against brute force with more distinct words and bigrams than any list of frequent ones."""
    rng = random.Random(7)
    docs = [(i, " ".join(f"{'t' if i % 2 else 'b'}{rng.randrange(4000)}" if rng.random() < 0.7 else "the of" for _ in range(60))) for i in range(100)]
    docs += [(200, None), (201, "only here"), (None, "no id")]
    target = spark.createDataFrame([(i,) for i in range(1, 80, 2)], "doc_id int")
    rows = lmscore.cross_entropy_difference(make(docs), target).collect()
    words = {d: re.findall(WS, t or "") for d, t in docs}
    kinds = len({x for w in words.values() for x in w}) + 1
    assert kinds > 1500

    def model(members):
        pairs, left, followers, one = {}, {}, {}, {}
        for d in members:
            for prev, x in zip(["^", *words[d]], words[d]):
                followers[prev] = followers.get(prev, 0) + ((prev, x) not in pairs)
                pairs[prev, x] = pairs.get((prev, x), 0) + 1
                left[prev] = left.get(prev, 0) + 1
                one[x] = one.get(x, 0) + 1
        total = sum(one.values()) + kinds

        def loss(prev, x):
            uni = (one.get(x, 0) + 1) / total
            return -np.log((pairs.get((prev, x), 0) + followers[prev] * uni) / (left[prev] + followers[prev])) if prev in left else -np.log(uni)

        return loss

    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
    for r in rows:
        t, b = model([d for d in range(1, 80, 2) if d != r.doc_id]), model([d for d in words if d != r.doc_id])
        pairs = list(zip(["^", *words[r.doc_id]], words[r.doc_id]))
        want = [np.mean([f(*p) for p in pairs]) if pairs else 0.0 for f in (t, b)]
        assert (r.n_words, r.target_loss, r.background_loss) == pytest.approx((len(pairs), *want), abs=2e-6)
    uniform = lmscore.cross_entropy_difference(make(docs), target.limit(0)).where("doc_id = 201").first()
    assert uniform.target_loss == pytest.approx(np.log(kinds), abs=1e-6)


def test_random_targets_are_not_told_apart(spark, make):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(60))) for i in range(300)]
    chosen = set(rng.sample(range(300), 150))
    rows = lmscore.cross_entropy_difference(make(docs), spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()
    inside, outside = ([r.score for r in rows if (r.doc_id in chosen) == side] for side in (True, False))
    noise = np.sqrt(np.var(inside) / len(inside) + np.var(outside) / len(outside))
    assert abs(np.mean(inside) - np.mean(outside)) < 4 * noise + 0.02


# sharding --------------------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(make, odd):
    rng = random.Random(8)
    docs = [(i, "x" * rng.randrange(400)) for i in range(600)] + [(1000 + i, "hot copy " * 20) for i in range(300)]
    rows = kdshards.kd_shards(make(docs), shards=5).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    size = {s: sum(r.size for r in rows if r.shard == s) for s in range(5)}
    assert max(size.values()) < 1.05 * min(size.values())
    for s in range(5):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    assert all(r.text_crc32 == zlib.crc32(dict(docs)[r.doc_id].encode()) and r.size == len(dict(docs)[r.doc_id]) + 1 for r in rows)
    assert len(kdshards.kd_shards(odd, shards=8).collect()) == 10
    assert kdshards.kd_shards(odd.limit(0), target_bytes=100).count() == 0
    plan = kdshards.kd_shards(odd, shards=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# language, toxicity ----------------------------------------------------------------------------


def test_recurrent_gradients_match_differences():
    net = langid.BiGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    units, target = np.array([[5, 9, 7], [9, 9, 1]], np.uint8), np.array([0, 2])
    _, grad = net.gradients(units, target)
    for name, at in (("rec_ahead", (1, 2)), ("rec_back", (0, 9)), ("in_back", (9, 5)), ("in_ahead", (7, 3)), ("out_back", (2, 1)), ("bias", (1,))):
        ends = []
        for step in (1e-3, -2e-3):
            net.p[name][at] += step
            ends.append(net.gradients(units, target)[0])
        net.p[name][at] += 1e-3
        assert grad[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=2e-3)


def test_language_of_held_out_documents(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) == sum(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    found = langid.with_language(odd)
    assert found.columns == [*odd.columns, "_lang", "_score"] and found.count() == 10
    assert all(r._lang == "und" and r._score == 0 for r in found.collect() if not re.search(r"\w", r.text or ""))
    assert langid.language_report(odd.limit(0)).count() == 0


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    e, move = np.exp(rng.normal(size=9)), np.exp(rng.normal(size=(2, 2)))
    lines, lengths = np.array([0, 4]), np.array([4, 5])
    got = toxicity.marginal_odds(e, lines, lengths, move)
    for start, n in zip(lines, lengths):
        mass = np.zeros((n, 2))
        for path in range(1 << n):
            s = [path >> k & 1 for k in range(n)]
            p = np.prod([e[start + k] if x else 1.0 for k, x in enumerate(s)]) * np.prod([move[a, b] for a, b in zip(s, s[1:])])
            for k, x in enumerate(s):
                mass[k, x] += p
        assert got[start : start + n] == pytest.approx(mass[:, 1] / mass[:, 0])


def test_toxic_documents_are_found(spark, make, odd):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(rng, 40, 300).split(" ")
        for k in range(3 * toxic):
            words.insert(rng.randrange(len(words)), f"vile{rng.choice('abc')}")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    marked = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(make(docs), marked).collect()
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in rows if r.held_out) >= 0.97 * sum(r.held_out for r in rows)
    text = dict(docs)
    spans = [text[r.doc_id][s.start : s.end] for r in rows for s in r.spans]
    assert spans and sum("vile" in s for s in spans) > 0.9 * len(spans)
    assert toxicity.toxicity_report(odd, marked).count() == 10
    assert {r.score for r in toxicity.toxicity_report(odd, marked.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_report(odd.limit(0), marked).count() == 0


# token counts ----------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens(make, odd, rule):
    docs = [(1, "one two\n\n\nthree é漢\nfour"), (2, "\n"), (3, None), (4, "no newline")]
    encode = attribution.encoder(attribution.read_ranks(attribution.VOCABULARY))
    for r in attribution.section_tokens(make(docs), rule=rule).collect():
        text = dict(docs)[r.doc_id] or ""
        tokens = [encode.decode_single_token_bytes(t) for t in encode.encode_ordinary(text)]
        parts = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert [text[s.start : s.end] for s in r.sections] == parts
        owner = [k for k, p in enumerate(parts) for _ in p.encode()]
        want, at, crossing = [0] * len(parts), 0, 0
        for t in tokens:
            mine = owner[at : at + len(t)]
            at += len(t)
            crossing += len(set(mine)) > 1
            want[{"start": mine[0], "end": mine[-1], "majority": max(sorted(set(mine)), key=mine.count)}[rule]] += 1
        assert ([s.tokens for s in r.sections], r.n_tokens, r.n_crossing) == (want, len(tokens), crossing)
    assert attribution.section_tokens(odd, rule=rule).count() == 10
    assert attribution.section_tokens(odd.limit(0), rule=rule).count() == 0
