"""The driver's contract: entry, queries and their SQL, with and without the language-model parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as E
from codeloom.plans import queries as own
from codeloom.runtime import shared_dir

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9)
        elif df[c].dtype.kind in "iu":
            df[c] = df[c].astype("int64")
    df = df.astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_entry_gives_rows(spark):
    assert E.entry(spark).count() == 3


def test_every_sql_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(own.SQL) >= 75


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = norm(own.QUERIES[name](spark, sf).toPandas()), norm(con.sql(own.SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert (a == b).all().all()


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert own.QUERIES[name](spark, sf).limit(1).count() == 1


def test_library_stands_without_the_llm_parts(tmp_path):
    for p in ("codeloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "codeloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert got.stdout.strip().endswith(" []")


@pytest.mark.parametrize("missing", ["tiktoken", "ahocorasick"])
def test_engine_queries_stay_where_a_library_is_missing(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(own.QUERIES)), str(len(own.SQL))]
    assert "without the language-model parts" in got.stderr


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_nothing_outside_imports_the_llm_parts():
    for p in (ROOT / "codeloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "codeloom.llm" not in p.read_text(encoding="utf-8"), p
