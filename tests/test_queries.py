"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from ragspark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder="/root/testdata/sf0.001"):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, folder, name):
    assert compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name)) is None


# a product with a one-row count or aggregate is the only nested loop allowed
@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_has_no_cross_join(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["answer_contexts", "rag_status", "route_questions", "hydrate_ranked"])
def test_the_corpus_is_scored_once(spark, folder, name):
    df = QUERIES[name](spark, folder)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_executors_do_not_need_the_package(tmp_path):
    """The entry file loaded from another folder, by a plain session."""
    import os
    import subprocess
    import sys

    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    code = (
        "import importlib.util as u; from pyspark.sql import SparkSession\n"
        f"s = u.spec_from_file_location('e', {entry!r}); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', m.queries()['vector_knn_all'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "rows 2500" in done.stdout, done.stderr[-2000:]
