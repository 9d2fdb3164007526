"""Every registered graph query against its SQL on the small tables."""

import os

import pytest

from arcweft import catalogue

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(cur.fetchall())


def test_flagship_plan_prunes_and_pushes(spark):
    from arcweft import explain_plan, table_graph

    plan = explain_plan(table_graph(spark, SF), catalogue.ENTRIES["hop_count_by_segment"].text)
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "struct<c_custkey:bigint,c_mktsegment:string>" in plan
    assert plan.count("Scan parquet") == 4  # two scans, each listed in the tree and in the details


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
