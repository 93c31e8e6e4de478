"""Derivatives, calibration and stretches of the toxicity model, and its scores on long texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ragspark.llm import toxicity


def likelihood(score, label, move):
    """Log-likelihood of one chain by enumeration."""
    n, total = len(score), 0.0
    def weight(s):
        return np.exp(sum(score[k] for k in range(n) if s[k]) + sum(move[a, b] for a, b in zip(s, s[1:])))
    for path in range(1 << n):
        total += weight([path >> k & 1 for k in range(n)])
    return np.log(weight(list(label)) / total)


def test_slopes_match_differences_of_the_likelihood():
    rng = np.random.default_rng(4)
    score, label, move = rng.normal(size=(3, 6)), rng.integers(0, 2, (3, 6)), rng.normal(size=(2, 2))
    by_score, by_move = toxicity.slopes(score, label, move)
    whole = lambda s, m: sum(likelihood(s[i], label[i], m) for i in range(3))
    step = 1e-5
    for i in range(3):
        for t in range(6):
            up, down = score.copy(), score.copy()
            up[i, t] += step
            down[i, t] -= step
            assert by_score[i, t] == pytest.approx((whole(up, move) - whole(down, move)) / (2 * step), abs=1e-6)
    for i in range(2):
        for j in range(2):
            up, down = move.copy(), move.copy()
            up[i, j] += step
            down[i, j] -= step
            assert by_move[i, j] == pytest.approx((whole(score, up) - whole(score, down)) / (2 * step), abs=1e-6)


def test_calibration_is_the_optimum_of_the_weighted_likelihood():
    rng = np.random.default_rng(5)
    top, mass = rng.random(200), rng.random(200) * 9
    label, weight = (rng.random(200) < top).astype(float), rng.random(200) + 0.5
    crf = toxicity.CRF()
    crf.calibrate(top, mass, label, weight)

    def loss(a):
        z = a[0] + a[1] * top + a[2] * np.log1p(mass)
        return (weight * (np.logaddexp(0, z) - label * z)).sum() + 0.5e-2 * (a[1] ** 2 + a[2] ** 2)

    best = loss(np.array(crf.scale))
    for k in range(3):
        for d in (-0.05, 0.05):
            a = np.array(crf.scale)
            a[k] += d
            assert loss(a) > best


@pytest.mark.parametrize("window", [1, 3, 64])
def test_worst_stretch_matches_brute_force(monkeypatch, window):
    monkeypatch.setattr(toxicity, "WINDOW", window)
    p, cuts = np.random.default_rng(6).random(40), np.array([0, 0, 5, 6, 40, 40])
    top, mass = toxicity.worst_stretch(p, cuts)
    for d, (a, b) in enumerate(zip(cuts, cuts[1:])):
        runs = [p[i : min(i + window, b)] for i in range(a, b)]
        if not runs:
            assert (top[d], mass[d]) == (0, 0)
            continue
        best = max(runs, key=lambda r: r.sum())
        assert mass[d] == pytest.approx(best.sum()) and top[d] == pytest.approx(best.max())


def test_length_does_not_make_clean_documents_toxic(spark, make):
    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    docs, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        text = words(80)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), f"vile{rng.choice('abc')}")
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    clean = [t for i, t in docs if i % 4]
    long_clean = "\n".join(rng.choice(clean) for _ in range(1250))  # 100 000 words
    late = " ".join(words(50_000) + ["vilea", "vileb", "vilec"])  # evidence beyond any prefix
    docs += [(1000, long_clean), (1001, "\n".join(clean[:40])), (1002, late), (1003, long_clean + "\nvilea vileb vilec")]
    marked = spark.createDataFrame([*labels, (1003, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(make(docs), marked).collect()}
    assert rows[1000].score < 0.5 and rows[1001].score < 0.5 and rows[1002].score >= 0.5 and rows[1003].score >= 0.5
    last = rows[1002].spans[-1]
    assert late[last.start : last.end].endswith("vilec")


def test_the_sample_is_bounded_whatever_repeats(spark, make):
    marked = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = make([(1, "same row")] * 30 + [(1, f"other text {i}") for i in range(30)] + [(2, "clean row")] * 5)
    both = marked.groupBy("doc_id").agg({"toxic": "max"}).toDF("_id", "_toxic")
    rows = toxicity.labelled_sample(docs, both, {0: 20, 1: 20}, 20).collect()
    assert len(rows) == 32 and len({r._text for r in rows}) == 32
    assert len(toxicity.labelled_sample(docs, both, {0: 20, 1: 20}, 2).collect()) <= 6
