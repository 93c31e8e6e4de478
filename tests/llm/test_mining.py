"""Hard negatives, byte-level BPE and the prefix trie against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from ragspark.llm import bytebpe, hardneg, prefixtrie

# hard negatives --------------------------------------------------------------------------------


def negatives_by_hand(rows, every, k=5, low=80, high=100):
    good = [(i, v, n) for i, (v, e, n) in enumerate(rows) if v is not None and n is not None and e is not None
            and all(x is not None and math.isfinite(x) for x in e)]
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in rows[i][1]] for i, _, _ in good}
    out = []
    for i, v, n in good:
        if v % every:
            continue
        scored = [(-sum(a * b for a, b in zip(whole[i], whole[j])), w, j, m) for j, w, m in good if j != i]
        for p in sorted(x for x in scored if x[3] == n)[:k]:
            inside = sorted(x for x in scored if x[3] != n and low * -p[0] <= 100 * -x[0] <= high * -p[0])
            out += [(v, p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(inside[:k], 1)]
    return sorted(out)


def vectors(spark, rows, partitions=3):
    kind = "vec_id long, embedding array<float>, label int, row string, score double, kind int"
    return spark.createDataFrame([(*r, "r", 0.5, 9) for r in rows], kind).repartition(partitions)


@pytest.mark.parametrize("anchors, block", [(3, 16), (1 << 15, 1 << 14), (5, 7)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, anchors, block):
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "FIRST_READ", 2)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(6)], rng.randrange(3)) for i in range(150)]
    same = [0.5, -0.25, 0.0, 0.1, 0.0, 0.3]
    rows += [(200 + i, same, i % 2) for i in range(40)]  # many ties
    rows += [(300, [0.0] * 6, 1), (301, [0.0] * 6, 2), (302, [-0.5] * 6, 1), (310, [0.9, 0.1], 1), (311, [], 0)]
    rows += [(None, same, 1), (7, None, 1), (10, same, None), (20, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (30, [float("nan")] * 6, 1),
             (40, [float("inf")] + [0.0] * 5, 2), (10, same, 1), (10, same, 1), (10, same, 0)]
    found = hardneg.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == negatives_by_hand(rows, 10)


def test_hard_negatives_of_few_or_no_rows(spark):
    is_anchor = F.col("vec_id") % 10 == 0
    assert hardneg.hard_negatives(vectors(spark, [(0, [1.0], 1)]).limit(0), is_anchor).count() == 0
    assert hardneg.hard_negatives(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)]), is_anchor).count() == 0
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]
    assert [tuple(r) for r in hardneg.hard_negatives(vectors(spark, rows), is_anchor).collect()] == [(0, 1, 1, 2, 65536, 58880)]


def test_reading_stops_early_and_large_scores_stay_exact():
    rng = np.random.default_rng(2)
    base = np.zeros((2000, 4), np.int64)
    base[:, 0] = np.sort(rng.integers(0, 100, 2000))[::-1]
    base[:10, 0] = 1000 - np.arange(10)
    block = hardneg.Block(base.astype(np.float32), np.arange(2000), np.zeros(2000, np.int64), np.arange(2000))
    best = hardneg.Best(5)
    depth = hardneg.read_lists(block, np.array([3, 0, 0, 0], np.float32), 0, lambda x: np.ones(len(x), bool), [best])
    assert depth == hardneg.FIRST_READ and best.id.tolist() == [0, 1, 2, 3, 4] and best.score.tolist() == [3000, 2997, 2994, 2991, 2988]
    for size, kind in ((200, np.float32), (10**6, np.float64), (10**9, np.int64)):
        x = np.array([[size, size - 1]])
        assert hardneg.exact_type(x, x) is kind
        assert int(x.astype(kind)[0] @ x.astype(kind)[0]) == size**2 + (size - 1) ** 2


# byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(rng, n):
    kinds = [
        lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x4E00, 0x9FA5), rng.randrange(0x400, 0x4FF)])),
        lambda: rng.choice("aeiou thers\n  '\t\r123"),
        lambda: chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])),
        lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"),
    ]
    return ["".join(kind() for _ in range(rng.randrange(200))) for kind in kinds for _ in range(n)]


@pytest.mark.parametrize("long", [2, 48, 10**6])
def test_words_are_merged_as_the_library_merges(monkeypatch, ranks, reference, long):
    monkeypatch.setattr(bytebpe, "LONG", long)
    merges = bytebpe.Merges(ranks)
    words_of = bytebpe.splitter(public_tokenizers.PATTERN, bytebpe.class_differences())
    for text in odd_texts(random.Random(long), 150):
        words = words_of(text)
        assert "".join(words) == text
        got = [int(x) for ids in merges.encode([w.encode() for w in words]) for x in ids]
        assert got == reference.encode_ordinary(text)
        assert b"".join(merges.decode(np.array(got, np.int64))) == text.encode()


@pytest.mark.parametrize("block", [200, 4 << 20])
def test_documents_are_encoded_and_decoded(spark, make, odd, ranks, reference, block):
    rng = random.Random(4)
    texts = odd_texts(rng, 25)
    docs = make([(i, t) for i, t in enumerate(texts)] + [(900 + i, "the same <|endoftext|> words") for i in range(30)]).unionByName(odd)
    encoded = bytebpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, block)
    want = sorted((str(r.doc_id), reference.encode_ordinary(r.text or "")) for r in docs.collect())
    got = encoded.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode_bytes(r.ids)).hexdigest()
    back = bytebpe.decode_documents(encoded, ranks).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert bytebpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_plain_pattern_splits_as_the_library(reference):
    plain = bytebpe.plain_pattern(public_tokenizers.PATTERN)
    # the first pattern, for text above U+FFFF only, finds nothing here
    quick = bytebpe.splitter("(?!)", {}, plain)
    slow = bytebpe.splitter(public_tokenizers.PATTERN, bytebpe.class_differences())
    words_of = bytebpe.splitter(public_tokenizers.PATTERN, bytebpe.class_differences(), plain)
    rng = random.Random(8)
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(every)
    for text in ["".join(f"a{c} {c}1{c}{c}'s" for c in every[i : i + 500]) for i in range(0, len(every), 500)] + odd_texts(rng, 20):
        want = slow(text)
        assert words_of(text) == want
        assert sum((reference.encode_ordinary(w) for w in want), []) == reference.encode_ordinary(text)
        if max(text, default="") <= "\uffff":
            assert quick(text) == want
    for other in (r"\w+|\s+", r"(?i:'s)| ?\p{L}+", r"\p{Lu}\p{Ll}*+", r"[]\s]+", r"(a)|b", r"[a&&b]"):
        assert bytebpe.plain_pattern(other) is None


def test_tasks_get_the_merge_tables_built(spark, make, monkeypatch, ranks, reference):
    here, build = os.getpid(), bytebpe.Merges.__init__

    def only_here(self, ranks):
        if os.getpid() != here:
            raise AssertionError("merge tables built again in a task")
        build(self, ranks)

    monkeypatch.setattr(bytebpe.Merges, "__init__", only_here)
    encoded = bytebpe.encode_documents(make([(i, f"some words {i}") for i in range(9)]), ranks, public_tokenizers.PATTERN)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: reference.encode_ordinary(f"some words {i}") for i in range(9)}
    rows = bytebpe.decode_documents(encoded, ranks).collect()
    assert {bytes(r.decoded).decode() for r in rows} == {f"some words {i}" for i in range(9)}


def test_a_bucket_is_encoded_in_bounded_parts_by_one_python_worker(spark, make, monkeypatch, ranks, reference):
    texts = [t for t in odd_texts(random.Random(12), 10) if t]
    merges, seen = bytebpe.Merges(ranks), []
    whole = merges.encode_flat
    merges.encode_flat = lambda words: seen.append(sum(map(len, words))) or whole(words)
    # every text is a block of its own, all of one bucket; a row has one block's words of the bucket
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], names=["doc", "part", "text"])
    words_in = public_tokenizers.PATTERN, bytebpe.class_differences()
    blocks = list(bytebpe.word_batches(words_in, 1, 1)(iter([batch])))
    words = {number: list(dict.fromkeys(bytebpe.splitter(*words_in)(t))) for number, t in enumerate(texts)}
    longest = max(sum(len(w.encode()) for w in x) for x in words.values())
    for most in (1, 3 * longest, 1 << 20):
        seen.clear()
        with monkeypatch.context() as patch:
            patch.setattr(bytebpe, "opened", lambda shared: merges)
            got = [r for b in bytebpe.encode_words(None, most)(iter(blocks)) for r in b.to_pylist()]
        assert max(seen) <= max(most, longest) and (len(seen) == 1) == (most == 1 << 20)
        assert {r["block"]: bytebpe.numbers(r["packed"]).tolist() for r in got} == {
            number: [i for w in x for i in reference.encode_ordinary(w)] for number, x in words.items()}
        for r in got:
            assert bytebpe.numbers(r["sizes"]).tolist() == [len(reference.encode_ordinary(w)) for w in words[r["block"]]]
    # a task runs one Python step: words, ids, documents, results; each further one is a worker that keeps its memory
    encoded = bytebpe.encode_documents(make(list(enumerate(texts))), ranks, public_tokenizers.PATTERN)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)^\W*(?:\(\d+\) )?MapInArrow ", plan)) == 4
    monkeypatch.setattr(bytebpe, "PART", 64)
    encoded = bytebpe.encode_documents(make(list(enumerate(texts * 2))), ranks, public_tokenizers.PATTERN, 200)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: reference.encode_ordinary(t) for i, t in enumerate(texts * 2)}


# prefix trie -----------------------------------------------------------------------------------


def rebuilt_by_hand(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie_by_hand(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    value = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in nodes.items()}
    kids = {p: [q for q in nodes if q and q[:-1] == p] for p in nodes}
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = value[p] + sum(saved[q] for q in kids[p])
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items())


def conversations(spark, rows, partitions=3):
    kind = "conv_id long, turn long, role string, text string, path string, kind int, depth long"
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], kind).repartition(partitions)


def trie(spark, rows):
    turns = prefixtrie.original_turns(conversations(spark, rows))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    nodes = prefixtrie.prefix_trie(prefixtrie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, taken, most=8))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    monkeypatch.setattr(prefixtrie, "BATCH", 5)
    monkeypatch.setattr(prefixtrie, "partitions", lambda _: 9)
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(61, 160, 3)]:  # some without a source
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "çé", None, ""])) for t in range(rng.randrange(1, 12))]
    for c in range(200, 290):  # one conversation, many copies
        rows += [(c, t, "user", f"turn {t}") for t in range(6)]
    rows += [(c, None, "system", "first") for c in range(0, 40, 2)]
    rows += [(None, 1, "user", "nowhere"), (300, 1, None, None), (301, None, None, None), (-3, 1, "user", "x")]
    rows += [(400, t, "user", f"long {t}") for t in range(1500)] + [(405, t, "user", f"long {t}") for t in range(1490)]
    want = trie_by_hand({c: p for c, p in rebuilt_by_hand([r for r in rows if r[0] not in (400, 405, -3)]).items()})
    assert trie(spark, [r for r in rows if r[0] not in (400, 405, -3)]) == want
    with_long = trie(spark, rows)
    assert max(r[1] for r in with_long) == 1500 and len(with_long) > len(want)


@pytest.mark.parametrize("shards", [1, 4])
def test_trie_of_few_rows(spark, monkeypatch, shards):
    monkeypatch.setattr(prefixtrie, "partitions", lambda _: shards)
    for rows in ([(5, 1, "user", "x")], [(6, 1, "user", "x")], [(5, 1, "u", "x"), (5, 1, "u", "x"), (10, 1, "u", "x")]):
        assert trie(spark, rows) == trie_by_hand(rebuilt_by_hand(rows))
    empty = conversations(spark, [(5, 1, "user", "x")]).limit(0)
    assert prefixtrie.prefix_trie(prefixtrie.original_turns(empty)).count() == 0
