import importlib.util
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAST = ("ink_by_recipe", "gain_parse", "option_rules", "trim", "composites", "print_plans", "derived_sizes", "file_names", "job_variants", "job_preflight", "latest_state", "job_resume", "sheet_rules", "debounced", "resampled")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    got = [tuple(cell(r[c]) for c in columns) for r in df.collect()]
    want = [tuple(cell(x) for x in r) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_rest_stands_alone():
    """Nothing outside inkgrid.llm needs it."""
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('inkgrid.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "import inkgrid.queries, inkgrid.oracles, inkgrid.sources.tables, inkgrid.streaming.progress, inkgrid.plans.journal\n"
        "assert not any(m.startswith('inkgrid.llm') for m in sys.modules)\n"
    )
    root = os.path.dirname(importlib.util.find_spec("__spark_entry__").origin)
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
