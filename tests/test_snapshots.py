"""Snapshot differences against a plain comparison of rows, and what is read for them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ragspark.sources import snapshots as S

SCHEMA = "k int, g string, v double, tags array<string>"


def _rows(rng, n):
    pick = [None, 0.0, 1.5, float("nan")]
    return {(k, g): (k, g, rng.choice(pick), rng.choice([None, [], ["x", None]])) for k in range(n) for g in "ab"}


def _plain(old, new):
    told = {}
    for key in old.keys() | new.keys():
        if key not in old:
            told[key] = "ADDED"
        elif key not in new:
            told[key] = "REMOVED"
        elif repr(old[key]) != repr(new[key]):
            told[key] = "CHANGED"
    return told


def _write(spark, rows, path, parts=8):
    return S.write_snapshot(spark.createDataFrame(list(rows.values()), SCHEMA), str(path), ["k", "g"], parts)


@pytest.mark.parametrize("seed", range(2))
def test_changes_equal_a_plain_comparison(spark, tmp_path, seed):
    rng = random.Random(seed)
    old = _rows(rng, 80)
    new = {key: row for key, row in _rows(rng, 90).items() if rng.random() < 0.9}
    a, b = _write(spark, old, tmp_path / "a"), _write(spark, new, tmp_path / "b")
    got = {(r.k, r.g): r.change for r in S.changes(a, b).collect()}
    assert got == _plain(old, new) and set(got.values()) == {"ADDED", "REMOVED", "CHANGED"}
    row = S.changes(a, b).where("change = 'ADDED'").first()
    assert row.before is None and (row.after.k, row.after.g) == (row.k, row.g)


def test_only_differing_parts_are_read(spark, tmp_path):
    old = _rows(random.Random(5), 200)
    new = {**old, (7, "a"): (7, "a", 99.0, None)}
    a, b = _write(spark, old, tmp_path / "a", 24), _write(spark, new, tmp_path / "b", 24)
    assert len(a.digests) == 24 and len(S.differing(a, b)) == 1
    found = S.changes(a, b)
    assert [(r.k, r.g, r.change, r.after.v) for r in found.collect()] == [(7, "a", "CHANGED", 99.0)]
    parts = S.differing(a, b)
    kept = [r[0] for r in a.read(parts).select(F.pmod(F.xxhash64("k", "g"), F.lit(24))).distinct().collect()]
    assert kept == parts


def test_a_null_moved_between_columns_is_a_change(spark, tmp_path):
    one = spark.createDataFrame([(1, 5, None)], "k int, a int, b int")
    two = spark.createDataFrame([(1, None, 5)], "k int, a int, b int")
    a, b = S.write_snapshot(one, str(tmp_path / "a"), ["k"], 4), S.write_snapshot(two, str(tmp_path / "b"), ["k"], 4)
    assert [r.change for r in S.changes(a, b).collect()] == ["CHANGED"]


def test_equal_and_empty_snapshots(spark, tmp_path):
    rows = _rows(random.Random(1), 10)
    a, b, none = _write(spark, rows, tmp_path / "a"), _write(spark, rows, tmp_path / "b"), _write(spark, {}, tmp_path / "c")
    assert S.differing(a, b) == [] and S.changes(a, b).count() == 0
    assert S.changes(none, none).count() == 0
    told = S.feed([none, a, b, none]).groupBy("version", "change").count().collect()
    assert sorted(map(tuple, told)) == [(1, "ADDED", 20), (3, "REMOVED", 20)]
    with pytest.raises(ValueError):
        S.differing(a, _write(spark, rows, tmp_path / "d", 4))
    with pytest.raises(ValueError):
        S.feed([a])
    assert S.read_snapshot(spark, a.path).digests == a.digests
