"""The driver's contract."""

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert all(callable(f) for f in q.values())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["nation", "month", "revenue", "rn"] and df.count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "top_n_per_group", "lag_ignore_nulls", "json_get_path", "scd2", "conditions_tables", "distinct_over_running", "recursive_outer_step", "recursive_aggregate_step", "merge_schema_evolution", "exists_two_levels"])
def test_some_queries_equal_the_oracle(spark, name):
    con = duckdb.connect()
    for t in con.execute(f"SELECT file FROM glob('{SF}/*.parquet')").fetchall():
        con.execute(f"CREATE VIEW {t[0].rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{t[0]}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    show = lambda rs: sorted(str([str(x)[:10] if hasattr(x, "year") else round(x, 4) if isinstance(x, float) else x for x in r]) for r in rs)
    assert show(df.select(*cols).collect()) == show(cur.fetchall())


@pytest.mark.parametrize("name,of", [("order_nulls_all", "customers"), ("order_by_alias_all", "nation")])
def test_the_whole_order_equals_the_oracle(spark, name, of):
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {of} AS SELECT * FROM '{folder}/{of}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = entry.queries()[name](spark, folder)
    want = cur.fetchall()
    assert set(got.columns) == set(cols)
    assert sorted(map(tuple, got.select("rn", *cols).collect()), key=lambda r: r[0]) == sorted(((r[-1], *r) for r in want), key=lambda r: r[0])
    assert len(want) == con.execute(f"SELECT count(*) FROM {of}").fetchone()[0]
