"""The registry: imports without a session, and queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT, DATA = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["edges_by_kind", "scope_chain_filter", "cfg_flows_to", "reach_forward", "pattern_direct", "call_resolution_all", "taint_paths", "diff_added", "json_roundtrip", "reach_backward", "taint_path_nodes", "taint_apply_roles", "removals", "front_end_nodes", "front_end_flows"])
def test_queries_say_what_their_sql_says(spark, name):
    import duckdb

    from lodegraph.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == names
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.select(*names).fetchall()))
