"""Streams over a table of many part files whose times are out of order, in several triggers, against the batch result."""

import functools

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.plans import registry
from panelwright.streaming import flows
from tests.test_oracles import table

FLOWS = ("stream_tumbling", "stream_sliding", "stream_sessions", "stream_once")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of 120 days: newest file first, and event_id 1 again with the same user and type much later."""
    top = tmp_path_factory.mktemp("many")
    kinds = ["error", "click"]
    rows = [(i, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} {(7 * i) % 24:02d}:00:00", i % 3, kinds[i % 2], float(i)) for i, d in enumerate(sorted(range(112), key=lambda d: (-(d % 4), d)))]
    rows += [(1, "2024-04-20 05:30:00", 1, "click", 1.0)]
    for n in range(0, len(rows), 30):
        part = spark.createDataFrame(rows[n : n + 30], "event_id long, ts string, user_id long, event_type string, value double")
        part.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{top}/events.parquet")
    return str(top)


@pytest.mark.parametrize("name", FLOWS)
@pytest.mark.parametrize("files", [1, 1000])
def test_many_files_equal_sql(spark, folder, monkeypatch, name, files):
    monkeypatch.setattr(flows, "table_arrivals", functools.partial(flows.table_arrivals, files=files))
    df = registry.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cursor = duck.execute(registry.ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cursor.description], cursor.fetchall())
