import duckdb

import __spark_entry__ as entry
from trailmill.jobs import registry

DIR = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(registry.ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_a_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name in ("classified_ways", "directed_edges", "ranked_loops"):
        got = registry.QUERIES[name](spark, DIR).toPandas()
        want = con.execute(registry.ORACLES[name]).df()[list(got.columns)]
        cols = list(got.columns)
        assert got.sort_values(cols).round(6).values.tolist() == want.sort_values(cols).round(6).values.tolist()
