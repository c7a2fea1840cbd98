import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = sorted(entry.registry.ORACLES)


def test_smoke(spark):
    assert entry.entry(spark).columns == ["dim", "value", "n", "rank"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", LIBRARY)
def test_queries_agree_with_their_sql(spark, duck, tmp_path, name):
    entry.queries()[name](spark, str(DATA)).write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {entry.oracle_sql()[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE got").fetchall())
    chosen = ", ".join(f'"{c}"' for c in columns)
    both = [duck.execute(f"SELECT count(*) FROM (SELECT {chosen} FROM {a} EXCEPT ALL SELECT {chosen} FROM {b})").fetchone()[0] for a, b in (("want", "got"), ("got", "want"))]
    assert both == [0, 0]


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "facetmill", tmp_path / "facetmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 60 and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)
