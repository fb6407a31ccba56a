"""Queries against their SQL on the smallest tables; a query's rows, sorted, must equal DuckDB's."""

import os

import pytest

from quire.plans import catalogue, more, rules  # noqa: F401

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


def rows(frame, columns):
    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return f"{float(v):.9g}"

    return sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in frame)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, AT)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["token_bucket", "markdown_blocks", "section_chunks", "page_number_lines", "abbreviations"])
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, AT).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
