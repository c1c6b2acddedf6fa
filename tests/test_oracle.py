"""Every registered query of the engine against its SQL counterpart in DuckDB; those without one must give rows."""

import os

import duckdb
import pytest

from loomspan.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "events lineitem embeddings part".split()

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want)
    for c in columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (name, c, got[~same].head(), want[~same].head())


def test_entry_works_without_the_training_data_operators():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['loomspan.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert 'tract_metrics' in e.oracle_sql()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
