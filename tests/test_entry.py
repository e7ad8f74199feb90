import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from docweave.sources.tables import TABLES

SMOKE = "/root/testdata/sf0.001"
HAVE_DATA = os.path.isdir(SMOKE)


def test_registry_shape():
    qs, orc = E.queries(), E.oracle_sql()
    from docweave.plans.queries import QUERIES
    assert set(QUERIES) <= set(orc) <= set(qs)          # every query of the engine has its DuckDB form


@pytest.mark.skipif(not HAVE_DATA, reason="fixture tables not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["question_id", "context", "n_chunks", "used_tokens"]
    assert df.count() >= 0


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.skipif(not HAVE_DATA, reason="fixture tables not present")
def test_every_query_matches_its_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    bad = []
    for k, sql in E.oracle_sql().items():
        sp = E.queries()[k](spark, SMOKE).toPandas()
        dd = con.execute(sql).df()
        cols = sorted(sp.columns)
        if cols != sorted(dd.columns) or len(sp) != len(dd):
            bad.append((k, "shape"))
            continue
        a = sorted((tuple(_norm(x) for x in r) for r in sp[cols].itertuples(index=False)), key=repr)
        b = sorted((tuple(_norm(x) for x in r) for r in dd[cols].itertuples(index=False)), key=repr)
        if a != b:
            bad.append((k, "values"))
    assert bad == []


@pytest.mark.skipif(not HAVE_DATA, reason="fixture tables not present")
def test_entry_from_another_working_directory(tmp):
    """Python workers import the package shipped with addPyFile, not from
    the caller's working directory."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print('ROWS', len(E.entry(s).collect()))\n"
            "print('SECTIONS', E.queries()['sections'](s, %r).count())\n") % (repo, SMOKE)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 40" in out.stdout and "SECTIONS" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("gone", ["xxhash", "docweave.llm", "corpus_pipeline"])
def test_entry_point_without_a_module_of_the_extra_queries(gone):
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r); sys.modules[%r] = None\n"
            "import __spark_entry__ as E\n"
            "from docweave.plans.queries import QUERIES\n"
            "assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())\n"
            "print('REST', 'pipeline' in E.queries())\n") % (repo, gone)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "REST False" in out.stdout, out.stderr[-2000:]
