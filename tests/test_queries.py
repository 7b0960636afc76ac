"""Every query of the cube engine that has SQL, against that SQL at the smallest scale."""

import duckdb
import pytest

import compare
from pixeltide.plans import catalog_of_queries as catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    mine = compare.rows_of(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        cursor = duck.execute(catalog.ORACLE_SQL[name])
        assert mine == compare.rows_of([c[0] for c in cursor.description], cursor.fetchall())
        assert sorted(df.columns) == sorted(c[0] for c in cursor.description)
    else:
        assert mine


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["plot_grey", "plot_rgb"])
@pytest.mark.parametrize("seed", [0, 24, 46])
def test_levels_do_not_hang_on_how_rows_are_dealt(spark, tmp_path, name, seed):
    """A mean of exactly 50 lies on the border of two levels; the SQL adds the rows of a file in their order."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (711, 712) ORDER BY event_id")
    events = con.execute("SELECT * FROM events").df().sample(frac=1, random_state=seed)
    (tmp_path / "events.parquet").mkdir()
    for i in range(4):
        events[i::4].to_parquet(tmp_path / f"events.parquet/{i}.parquet", coerce_timestamps="us")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    want = compare.rows_of([c[0] for c in cursor.description], cursor.fetchall())
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert compare.rows_of(df.columns, df.collect()) == want
