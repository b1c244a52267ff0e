"""Every registered post query against its SQL on the small tables."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from upwell import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ["events", "documents"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = plain([tuple(r) for r in df.collect()], df.columns), plain(cur.fetchall(), names)
    assert got == want and got


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_without_the_corpus_operators(tmp_path):
    """The registry still works where the optional subpackage is missing."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "upwell", tmp_path / "upwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_without_a_library_of_the_corpus_operators(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('absent')")
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('absent')")
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{root}"}, check=True)
