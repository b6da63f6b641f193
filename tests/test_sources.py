import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.sources import readers, sinks
from panelwright.streaming import flows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_text_csv_keeps_blanks_and_refuses_unknown_columns(spark, tmp_path):
    path = write(tmp_path / "a.csv", "x,y\n1,\n,2\n")
    rows = readers.text_csv(spark, path, ["x", "y", "z"]).collect()
    assert [tuple(r) for r in rows] == [("1", "", ""), ("", "2", "")]
    with pytest.raises(ValueError, match="unknown columns"):
        readers.text_csv(spark, path, ["x"])


def test_titled_csv(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'Report of May\n\nName,Cost\n"A, B",1.5\nC,n.a.\n')
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("cost", T.DoubleType())])
    assert [tuple(r) for r in readers.titled_csv(spark, path, schema).collect()] == [("A, B", 1.5), ("C", None)]


def test_typed_marks_failures(spark):
    df = spark.createDataFrame([("1", "05/01/2020", "1.5"), ("2", "x", ""), ("3", "", "y")], "id string, d string, n string")
    rows = {r["id"]: r for r in readers.typed(df, {"d": "dd/MM/yyyy"}, ["n"]).collect()}
    assert str(rows["1"]["d"]) == "2020-01-05" and rows["1"]["n"] == 1.5 and rows["1"]["parse_fails"] == []
    assert rows["2"]["parse_fails"] == ["parse_fail:d"] and rows["3"]["parse_fails"] == ["parse_fail:n"]


def test_packed_numbers(spark):
    a, b = readers.packed_numbers(F.lit("12 (3.5)"))
    assert tuple(spark.range(1).select(a, b).first()) == (12.0, 3.5)


def test_json_lines_latest_wins_and_bad_lines_are_kept(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", '{"k": "a", "at": "2020", "v": 1}\n{"k": "a", "at": "2021", "v": 2}\nnot json\n{"k": "b", "at": "2020", "v": 3}\n')
    good, bad = readers.json_lines(spark, path, "k string, at string, v int", "k", ["at"])
    assert sorted((r["k"], r["v"]) for r in good.collect()) == [("a", 2), ("b", 3)]
    assert [r["_bad"] for r in bad.collect()] == ["not json"]


def test_rss(spark, tmp_path):
    path = write(tmp_path / "f.xml", "<rss><channel><item><title>Bridge late - The Paper</title><link>http://x/1</link><source>The Paper</source><description>&lt;b&gt;A&lt;/b&gt; text</description><pubDate>Tue, 05 May 2020 10:00:00 GMT</pubDate></item></channel></rss>")
    row = readers.rss(spark, path).first()
    assert row["title"] == "Bridge late" and row["text"] == "A text" and str(row["published"]) == "2020-05-05 10:00:00"


def test_html_tables_and_fill_down(spark):
    html = "<table><tr><th>State</th><th>N</th></tr><tr><td>A</td><td>1</td></tr><tr><td></td><td><b>2</b></td></tr></table>"
    cells = readers.html_tables(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html")
    wide = cells.where("row > 0").groupBy("k", "row").pivot("cell", [0, 1]).agg(F.first("text"))
    filled = readers.fill_down(wide.withColumnsRenamed({"0": "state", "1": "n"}), ["k"], "row", ["state"])
    assert sorted((r["row"], r["state"], r["n"]) for r in filled.collect()) == [(1, "A", "1"), (2, "A", "2")]


def test_optional_table(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none"), "a int").count() == 0
    spark.range(3).select(F.col("id").cast("int").alias("a")).write.parquet(str(tmp_path / "some"))
    assert readers.optional(spark, str(tmp_path / "some"), "a int").count() == 3


def test_upsert_replaces_rows_and_keeps_old_columns(spark, tmp_path):
    table = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k int, first string, v int")
    sinks.upsert(make([(1, "a", 1), (2, "a", 2)]), table, ["k"], ("first",))
    sinks.upsert(make([(2, "b", 3), (3, "b", None)]), table, ["k"], ("first",))
    sinks.upsert(make([(3, "c", 4)]), table, ["k"], ("first",))
    assert sorted(tuple(r) for r in sinks.read_current(spark, table).collect()) == [(1, "a", 1), (2, "a", 3), (3, "b", 4)]


def test_failed_write_leaves_the_version(spark, tmp_path):
    table = str(tmp_path / "v")
    sinks.write_version(spark.range(2), table)
    bad = spark.range(2).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_version(bad, table)
    assert sinks.read_current(spark, table).count() == 2


def test_insert_once_and_log(spark, tmp_path):
    path = str(tmp_path / "alerts")
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert sinks.insert_once(make([(1, "a"), (1, "b"), (2, "a")]), path, ["k"]) == 2
    assert sinks.insert_once(make([(2, "z"), (3, "a")]), path, ["k"]) == 1
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "a")]
    log = sinks.append_log(sinks.append_log(None, make([(1, "a")]), ["k"]), make([(1, "b"), (2, "c")]), ["k"])
    assert sorted(tuple(r) for r in log.collect()) == [(1, "a"), (2, "c")]


def test_quarantine_csv_and_audit(spark, tmp_path):
    held = spark.createDataFrame([(1, "r1"), (2, "r1"), (2, "r2")], "k int, rule_id string")
    assert {r["rule_id"]: r["n_rows"] for r in sinks.quarantine(held, str(tmp_path / "q")).collect()} == {"r1": 2, "r2": 1}
    sinks.printed_csv(spark.createDataFrame([(True, None)], "b boolean, s string"), str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("true", None)]
    sinks.audit(spark, str(tmp_path / "log"), "merge", winner=1)
    assert spark.read.json(str(tmp_path / "log")).first()["event"] == "merge"


def test_files_are_ingested_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox / "a.txt", "one")
    write(inbox / "b.txt", "two")
    write(inbox / "c.txt", "one")
    found = flows.file_hashes(spark, str(inbox), "v1")
    fresh = flows.new_files(found, found.limit(0))
    assert fresh.count() == 2
    assert flows.new_files(found, fresh).count() == 0
    assert flows.new_files(flows.file_hashes(spark, str(inbox), "v2"), fresh).count() == 2


def test_stream_results_do_not_depend_on_batches(spark, tmp_path):
    events = spark.range(400).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("k"))
    events.repartition(7).write.parquet(str(tmp_path / "e"))
    counts = []
    for files in (1, 100):
        stream = flows.arrivals(spark, str(tmp_path / "e"), events.schema, files=files)
        flow = flows.tumbling(stream, "ts", "1 day", ["k"], "3650 days", [F.count("*").alias("n")])
        rows = flows.latest(spark, flows.run_available(flow, str(tmp_path / f"o{files}"), "update"), ["start", "k"])
        counts.append(sorted((str(r["start"]), r["k"], r["n"]) for r in rows.collect()))
    assert counts[0] == counts[1] and sum(n for *_, n in counts[0]) == 400


def test_change_alerts_have_stable_ids(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    one, two = (sorted(r["alert_id"] for r in flows.change_alerts(old, new, ["k"], ["v"]).collect()) for _ in range(2))
    assert one == two and len(one) == 3
