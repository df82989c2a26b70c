import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from hindcast.plans import registry

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def test_every_query_has_a_callable_and_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.QUERIES) >= 80
    assert all(callable(f) for f in entry.queries().values())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["taker_executions", "status_scd2", "kappa", "episodes"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    key = lambda d: sorted(tuple(map(str, r)) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False))
    assert sorted(got.columns) == cols and key(got) == key(want)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for name in ("hindcast", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "hindcast" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bars_grid' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
