"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import corpus_pipeline
from ragspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, folder, name):
    assert compare(spark, connect(folder), folder, name, QUERIES[name], ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toArrow())
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[2] == kept[1] and kept[-1] > 0.7 * kept[0]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert final.count() == kept[-1] and final.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == kept[-1]


def test_pipeline_takes_empty_and_odd_tables(spark, odd, folder):
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, folder).count()


def test_pipeline_keeps_one_of_many_copies(spark, make, folder):
    """Of each group of ten or more exact copies one whole text reaches the last stage, and of near-copies every shared line."""
    def body(name, n):
        return "\n".join(" ".join(f"{name}{i}x{k}" for k in range(9)) for i in range(n))

    copies = {"a": 12, "b": 40, "c": 10}
    rows = [(100 * g + i, body(name, 8)) for g, (name, n) in enumerate(copies.items(), 1) for i in range(n)]
    rows += [(1000 + i, f"{body('near', 8)}\n{body(f'own{i}', 2)}") for i in range(15)]
    docs = make(rows + [(2000, body("alone", 5))])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toArrow())
    texts = [r.text for r in docs.collect()]
    assert [texts.count(body(name, 8)) for name in copies] == [1, 1, 1]
    assert sum(body("near", 8) in t for t in texts) == 1 and all(any(body(f"own{i}", 2) in t for t in texts) for i in range(15))
    assert texts.count(body("alone", 5)) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).where("round_trip").collect()
    assert {100, 200, 300, 1000, 2000} <= {r.doc_id for r in last}


def test_executors_do_not_need_the_package(tmp_path):
    """Operators that send models, run from another folder by a plain session."""
    import os
    import subprocess
    import sys

    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "__spark_entry__.py")
    code = (
        "import importlib.util as u; from pyspark.sql import SparkSession\n"
        f"s = u.spec_from_file_location('e', {entry!r}); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "names = ('op1_decontamination', 'op8_language_id', 'op10_toxicity')\n"
        "print('rows', [m.queries()[n](spark, '/root/testdata/sf0.001').count() for n in names])\n"
        "for n in names: m.queries()[n](spark, '/root/testdata/sf0.001').write.format('noop').mode('overwrite').save()\n"
        "print('done')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "done" in done.stdout, done.stderr[-2000:]
