"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from graphloom.plans import catalog, samples  # noqa: F401

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return Counter(tuple(tidy(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    found = catalog.queries()[name](spark, SF)
    cursor = database.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, cursor.fetchall())


def test_view_has_its_roots(spark):
    found = catalog.queries()["project_visible"](spark, SF).collect()
    nodes = [r.id for r in found if r.kind == "node"]
    assert catalog.ROOT in nodes and len(nodes) <= 30 and len(nodes) == len(set(nodes))


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_optional_parts(tmp_path):
    (tmp_path / "graphloom").mkdir()
    for part in (ROOT / "graphloom").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "graphloom" / part.name).symlink_to(part)
    code = "import sys; sys.path[:] = [p for p in sys.path if 'repo' not in p]; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 50; print(len(q))"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_scratch_tables_can_be_removed(spark):
    from graphloom.plans.scratch import clear_scratch, materialize, scratch_path

    folder = Path(scratch_path(spark, "x").split("://")[-1].removeprefix("file:")).parent
    assert materialize(spark.range(3)).count() == 3 and folder.exists()
    clear_scratch(spark)
    assert not folder.exists()
