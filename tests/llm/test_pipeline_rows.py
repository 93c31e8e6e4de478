"""No stage loses rows or columns; foreign text goes; passages are cut out of what stays."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import decontaminate, langid, simhash
from ragspark.llm.kernel import SpanHash


def test_groups_with_null_and_repeated_ids_keep_a_row_each(spark, make):
    rng = random.Random(3)
    texts = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(30)) for c in "abcd"]
    docs = make([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[3]), (7, texts[3])])
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3])])
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def plain_mean(net, text):
    """Mean of the labels of every byte of every word, read one byte after the other."""
    def states(d, word):
        h, out, k = np.zeros(net.hidden), [], net.hidden
        for b in word:
            a, r = net.p[f"in_{d}"][b].astype(float), net.p[f"rec_{d}"].astype(float)
            x = h @ r
            z = 1 / (1 + np.exp(-(a[:k] + x[:k])))
            reset = 1 / (1 + np.exp(-(a[k : 2 * k] + x[k : 2 * k])))
            new = np.tanh(a[2 * k :] + reset * x[2 * k :])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    total, n = np.zeros(len(net.p["bias"])), 0
    for word in text.lower().split():
        if not any(97 <= b <= 122 or b >= 128 for b in word):
            continue
        for i in range(0, len(word), langid.WIDTH):
            part = word[i : i + langid.WIDTH]
            ahead, back = states("ahead", part), states("back", part[::-1])[::-1]
            for f, b in zip(ahead, back):
                s = net.p["bias"] + f @ net.p["out_ahead"] + b @ net.p["out_back"]
                p = np.exp(s - s.max())
                total += p / p.sum()
                n += 1
    return total / max(n, 1), n


def test_pooled_labels_match_a_plain_loop_over_bytes():
    net = langid.BiGRU(3, 5)
    texts = [b"Some Words here, and here", b"", "Ünïcode çé 123 42".encode(), b"x" * 100 + b" y", b"9 8 7"]
    got, length = langid.pooled(net, SpanHash(), texts)
    for row, n, text in zip(got, length, texts):
        want, count = plain_mean(net, text)
        assert n == count and row == pytest.approx(want, abs=1e-5)


FOREIGN = "Съешь ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок. "
NOISE = "xkcdqz wrtpl kjhgf mnbvc zxqwp lkjh trwq pplkj zzxc vbnm "


def test_language_stage_rejects_foreign_text_and_noise_and_keeps_clean_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(90001, FOREIGN * 3, None), (90002, NOISE * 6, None), (90003, "12345 678", None)], "doc_id long, text string, lang string")
    both = docs.unionByName(odd, allowMissingColumns=True).withColumns(
        {c: F.lit(1) for c in ("_plain", "_lang", "_score", "lang_pred", "row", "score", "positions", "letters")})
    kept = langid.accepted(both)
    assert kept.columns == both.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {90001, 90002, 90003}
    clean = docs.where("length(text) >= 200 and text not like '%!!%'").select("doc_id").collect()
    assert sum(r.doc_id in ids for r in clean) >= 0.995 * len(clean)


def test_passages_are_cut_out_of_documents_that_stay(spark, make):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    lead, tail = " ".join(f"é{i}" for i in range(500)), " ".join(f"w{i}" for i in range(500))
    docs = make([(1, f"{lead} {item}. {tail}"), (2, item), (3, tail), (None, f"{item} {lead}"), (None, lead), (5, None)])
    left = {(r.doc_id, r.text): r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(left) == {(1, f"{lead} . {tail}"), (3, tail), (None, f" {lead}"), (None, lead), (5, None)}
    assert left[1, f"{lead} . {tail}"].n_chars == len(lead) + len(tail) + 3 and left[3, tail]._text == "x"
    assert left[5, None].n_chars == 0
