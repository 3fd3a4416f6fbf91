import duckdb
import pytest

import __spark_entry__ as entry
from placeweave import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"jaro_winkler_pairs"}))
def test_query_equals_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(oracles.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
