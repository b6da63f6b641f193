"""Alerts by state, outcomes by an outer join and the tail of a table: several starts, late rows, state that shrinks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelwright.streaming import flows

START = datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, seq long, tier string"


def told(rows, forget_days=10):
    """Alerts of rows in the order of time."""
    last, out = {}, []
    for key, at, seq, tier in sorted(rows, key=lambda r: (r[1], r[2])):
        was, before = last.get(key, (None, None))
        is_new = was is None or at - before > timedelta(days=forget_days)
        if found := flows.tier_alert(was, is_new, tier):
            out.append((key, seq, *found))
        last[key] = tier, at
    return sorted(out)


def feed(spark, folder, inbox, rows, watch=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    stream = flows.tier_alerts(flows.arrivals(spark, inbox, spark.createDataFrame([], SCHEMA).schema), "key", "at", "seq", "tier", "1 day", 10)
    flows.run_available(stream, folder, "append", watch=watch)
    return sorted((str(r["key"]), r["seq"], r["kind"], r["severity"]) for r in spark.read.parquet(f"{folder}/rows").collect())


def test_alerts_over_starts_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(6)}", START + timedelta(hours=5 * i), i, rng.choice(flows.TIERS)) for i in range(120)]
    folder, inbox = str(tmp_path / "flow"), str(tmp_path / "in")
    for n in range(0, 120, 40):
        got = feed(spark, folder, inbox, rows[n : n + 40])
    assert got == told(rows) and {g[2] for g in got} == {"new", "tier_up", "tier_down"}


def test_late_rows_are_dropped_and_state_shrinks(spark, tmp_path):
    folder, inbox, seen = str(tmp_path / "flow"), str(tmp_path / "in"), []
    watch = lambda p: seen.append(p["stateOperators"][0]["numRowsTotal"])
    first = [(f"k{i}", START + timedelta(hours=i), i, "low") for i in range(20)]
    feed(spark, folder, inbox, first, watch)
    later = [("k1", START + timedelta(days=40), 100, "critical"), ("k2", START + timedelta(days=40), 101, "odd"), (None, START + timedelta(days=40), 102, "low")]
    feed(spark, folder, inbox, later, watch)
    got = feed(spark, folder, inbox, [("k3", START + timedelta(days=5), 200, "critical"), ("k1", START + timedelta(days=41), 201, "high")], watch)
    assert seen[0] == 20 and seen[-1] <= 2  # k1 and the null key
    # 200 came 35 days late, 101 has no known tier; k1 was forgotten before 100.
    assert [g for g in got if g[1] >= 100] == [("None", 102, "new", 1), ("k1", 100, "new", 2), ("k1", 201, "tier_down", 1)]


def test_changes_of_tier():
    assert flows.tier_alert(None, True, "high") == ("new", 2) and flows.tier_alert("low", True, "low") == ("new", 1)
    assert flows.tier_alert("low", False, "critical") == ("tier_up", 3) and flows.tier_alert("medium", False, "high") == ("tier_up", 2)
    assert flows.tier_alert("critical", False, "high") == ("tier_down", 1) and flows.tier_alert("high", False, "low") == ("tier_down", 1)
    assert flows.tier_alert("low", False, "medium") is None and flows.tier_alert("high", False, "high") is None


def test_outcomes_fill_open_predictions_within_their_time(spark, tmp_path):
    made, came, folder, kept = str(tmp_path / "made"), str(tmp_path / "came"), str(tmp_path / "flow"), []
    day = lambda n: START + timedelta(days=n)
    steps = [([(1, day(0)), (2, day(1)), (3, day(2))], [(1, day(3))]), ([(4, day(30))], [(2, day(25)), (9, day(30))]), ([(5, day(60))], [(3, day(4)), (4, day(35)), (7, day(60))])]
    schemas = "k long, made timestamp", "k long, came timestamp"
    for predictions, outcomes in steps:
        spark.createDataFrame(predictions, schemas[0]).coalesce(1).write.mode("append").parquet(made)
        spark.createDataFrame(outcomes, schemas[1]).coalesce(1).write.mode("append").parquet(came)
        streams = [flows.arrivals(spark, p, spark.createDataFrame([], s).schema) for p, s in ((made, schemas[0]), (came, schemas[1]))]
        joined = flows.realised_stream(*streams, ["k"], "made", "came", "10 DAYS", "1 day")
        flows.run_available(joined, folder, "append", watch=lambda p: kept.append(p["stateOperators"][0]["numRowsTotal"]))
    got = {r["k"]: r["came"] for r in spark.read.parquet(f"{folder}/rows").collect()}
    # 2's outcome came after 24 days, 3's row came when the watermark had passed it; 5 is still open.
    assert got == {1: day(3), 2: None, 3: None, 4: day(35)}
    assert kept[-1] <= 4


def test_tail_tells_new_rows_once_with_a_heartbeat(spark, tmp_path):
    table, folder = str(tmp_path / "alerts"), str(tmp_path / "tail")
    add = lambda ids: spark.createDataFrame([(i, f"k{i % 2}") for i in ids], "id long, key string").write.mode("append").parquet(table)
    poll = lambda now: (lambda t: ([r["id"] for r in t[0].collect()], t[1]))(flows.tail(spark, table, "id", folder, 10.0, now, F.col("key") == "k1"))
    add([1, 2, 3])
    assert poll(0.0) == ([], True)  # begins at the newest
    add([5, 4, 7])
    assert poll(3.0) == ([5, 7], False)
    assert poll(12.0) == ([], True) and poll(13.0) == ([], False)
    add([8])
    assert poll(14.0) == ([], False)
    add([9])
    assert poll(30.0) == ([9], True)


def test_a_poll_that_broke_off_is_told_again(spark, tmp_path, monkeypatch):
    table, folder = str(tmp_path / "alerts"), str(tmp_path / "tail")
    spark.createDataFrame([(1,)], "id long").write.parquet(table)
    flows.tail(spark, table, "id", folder, 10.0, 0.0)
    spark.createDataFrame([(2,)], "id long").write.mode("append").parquet(table)
    with monkeypatch.context() as broken, pytest.raises(OSError):
        broken.setattr(flows, "write_version", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        flows.tail(spark, table, "id", folder, 10.0, 1.0)
    assert [r["id"] for r in flows.tail(spark, table, "id", folder, 10.0, 2.0)[0].collect()] == [2]
