"""Every registered query with SQL is run on the smallest driver tables and compared row for row with DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from panelwright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert [f.name for f in __spark_entry__.entry(spark).schema] == ["k", "q", "age", "seen", "orders_to_date", "vs_first", "change", "band"]


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__

    found = importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None if name in ("panelwright.llm", "corpus_pipeline") else found(name))
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLE_SQL)
