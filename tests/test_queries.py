import os
import subprocess
import sys

import duckdb
import pytest

from lodestone import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_sql(spark, duck, name):
    got = engine.queries()[name](spark, DATA).toPandas()
    want = duck.sql(engine.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


def test_entry(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and E.entry(spark).count() <= 20


def test_entry_without_the_corpus_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; assert len(E.queries()) > 80 and 'pipeline' not in E.queries(); assert set(E.oracle_sql()) <= set(E.queries())"
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "lodestone").mkdir()
    for name in os.listdir(f"{root}/lodestone"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/lodestone/{name}", tmp_path / "lodestone" / name)
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
