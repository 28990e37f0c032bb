"""Queries on rows that only larger tables hold, against their SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture
def as_sql(spark, tmp_path):
    """Whether a query gives on one table what its SQL gives, rows in any order."""
    import duckdb

    def compare(query, name, table):
        pq.write_table(table, tmp_path / f"{name}.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        ours, theirs = registry.queries()[query](spark, str(tmp_path)).toArrow(), con.sql(SQL[query]).to_arrow_table()
        rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in sorted(t.column_names)], strict=True))) if t.num_rows else []
        assert sorted(ours.column_names) == sorted(theirs.column_names) and rows(ours) == rows(theirs)

    return compare


def test_names_of_two_forgotten_identities_count_twice(as_sql):
    keys = [k for k in range(3000) if k % 5]
    as_sql("forget_and_reserve", "supplier", pa.table({"s_suppkey": pa.array(keys, pa.int64()), "s_nationkey": pa.array([k % 1000 % 7 for k in keys], pa.int32())}))


def test_markup_keeps_letters_apart(as_sql):
    titles = ["Y Y Y Y ", "A&amp;B", "x<sup>2</sup> **a**b", "[y](a_b)", "a-\nb &nbsp;&#39;", None]
    as_sql("page_views", "pages", pa.table({"page_id": pa.array(range(6), pa.int64()), "html": [t and f"<title>{t}</title>&copy;" for t in titles]}))


def test_syntax_of_one_file_is_read_on_all_cores(spark, small):
    assert registry.queries()["span_syntax"](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_lines_read_by_themselves_give_the_paragraph():
    import random

    from spanloom.operators import syntax

    r, bits = random.Random(2), [*"\\`*_~=$<>![]()\"'\n\n|#a1. ", "**", "[x](y)", "<br>", "<b c=\"d\">", "`q`", "[!N]\n", "$x$", "é"]
    for _ in range(3000):
        t = "x" + "".join(r.choice(bits) for _ in range(25)).replace("\n\n", "\n").replace("\n \n", "\n") + "x"
        if all(line.strip() for line in t.split("\n")) and "```" not in t:
            assert syntax.read_inline(t) == sorted(syntax._line_spans(t, 0, len(t)), key=lambda x: (x[0], -x[1])), t
