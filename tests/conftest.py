import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with DuckDB's result of a statement, rows in any order, columns by name."""

    def compare(df, sql):
        ours, theirs = df.toArrow(), duck.sql(sql).to_arrow_table()
        assert sorted(ours.column_names) == sorted(theirs.column_names)
        rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in sorted(t.column_names)], strict=True))) if t.num_rows else []
        assert rows(ours) == rows(theirs)

    return compare
