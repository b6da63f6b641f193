"""Sources, sinks and text functions, written from driver tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import dates as D
from panelwright.functions import scalars as S
from panelwright.functions import text as X
from panelwright.operators import relational, serving, temporal
from panelwright.plans.registry import query
from panelwright.sources import readers, sinks
from panelwright.sources.tables import read
from panelwright.streaming import flows


@query("src_text_csv", "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment, '' AS note FROM customer")
def src_text_csv(spark, sf_dir):
    folder = flows.flow_folder(spark)
    segment = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), segment.alias("segment")).write.csv(folder, header=True, emptyValue="")
    return readers.text_csv(spark, folder, ["k", "name", "segment", "note"])


_RAW = """r AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS x FROM orders)"""


def _raw(spark, sf_dir):
    i = F.col("o_orderkey")
    d = F.when(i % 7 == 0, "bad").when(i % 11 == 0, "").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return read(spark, sf_dir, "orders").select(i.alias("i"), d.alias("d"), F.when(i % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("x"))


@query("src_typed", f"WITH {_RAW} SELECT i, CAST(try_strptime(d, '%d/%m/%Y') AS DATE) AS d, TRY_CAST(x AS DOUBLE) AS x, concat_ws(';', CASE WHEN d = 'bad' THEN 'parse_fail:d' END, CASE WHEN x = 'n/a' THEN 'parse_fail:x' END) AS fails FROM r")
def src_typed(spark, sf_dir):
    return readers.typed(_raw(spark, sf_dir), {"d": "dd/MM/yyyy"}, ["x"]).select("i", "d", "x", F.array_join("parse_fails", ";").alias("fails"))


@query("src_staged", f"WITH {_RAW} SELECT i, TRY_CAST(x AS DOUBLE) AS x, 'orders' AS source_table, sha256(concat_ws('|', i, d, x)) AS raw_hash FROM r")
def src_staged(spark, sf_dir):
    """Typed staging rows that know the raw row they come from."""
    raw = _raw(spark, sf_dir).withColumns({"source_table": F.lit("orders"), "raw_hash": F.sha2(F.concat_ws("|", "i", "d", "x"), 256)})
    return readers.typed(raw, {"d": "dd/MM/yyyy"}, ["x"]).select("i", "x", "source_table", "raw_hash")


@query("src_titled_csv", "SELECT n_nationkey AS code, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def src_titled_csv(spark, sf_dir):
    folder = flows.flow_folder(spark)
    line = F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")
    # The nation table has a fixed number of rows.
    lines = read(spark, sf_dir, "nation").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    lines.select(F.concat(F.lit("Nations of the report\n\ncode,name,region\n"), "body")).coalesce(1).write.text(folder)
    return readers.titled_csv(spark, folder, T.StructType.fromDDL("code int, name string, region double"))


@query("src_packed", "SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS a, p_size + 0.5 AS b FROM part")
def src_packed(spark, sf_dir):
    cells = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey"), F.lit(" ("), F.col("p_size"), F.lit(".5)")).alias("cell"))
    a, b = readers.packed_numbers(F.col("cell"))
    return cells.select("p_partkey", a.alias("a"), b.alias("b"))


@query(
    "src_html_tables",
    """SELECT r_regionkey AS k, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS "row", r_name AS region, n_name AS name
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def src_html_tables(spark, sf_dir):
    """A table for each region whose group column is printed once and filled down."""
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = places.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = F.transform("n", lambda n, i: F.concat(F.lit("<tr><td>"), F.when(i == 0, F.col("r_name")).otherwise(""), F.lit("</td>\n<td class='x'><b>"), n["n_name"], F.lit("</b></td></tr>")))
    pages = names.select(F.col("r_regionkey").alias("k"), F.concat(F.lit("<table>"), F.array_join(rows, "\n"), F.lit("</table>")).alias("html"))
    cells = readers.html_tables(pages, "k", "html").groupBy("k", "row").pivot("cell", [0, 1]).agg(F.first("text"))
    return readers.fill_down(cells.withColumnsRenamed({"0": "region", "1": "name"}), ["k"], "row", ["region"]).select("k", "row", "region", "name")


def _lines(spark, sf_dir):
    folder = flows.flow_folder(spark)
    good = F.to_json(F.struct("user_id", "event_id", "value"))
    read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, '{"broken').otherwise(good).alias("value")).write.text(folder)
    return readers.json_lines(spark, folder, "user_id long, event_id long, value double", "user_id", ["event_id"])


@query("src_json_lines", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 50 <> 0 GROUP BY user_id")
def src_json_lines(spark, sf_dir):
    return _lines(spark, sf_dir)[0].select("user_id", "event_id", "value")


@query("src_json_bad", "SELECT '{\"broken' AS line, count(*) AS n FROM events WHERE event_id % 50 = 0")
def src_json_bad(spark, sf_dir):
    return _lines(spark, sf_dir)[1].groupBy(F.col("_bad").alias("line")).agg(F.count("*").alias("n"))


@query(
    "src_rss",
    """SELECT concat(p_name, ' ', p_partkey) AS title, concat('http://x.org/', p_partkey) AS link, p_brand AS source, concat('About ', p_type, ' now') AS text,
    TIMESTAMP '2024-03-05 10:00:00' AS published FROM part""",
)
def src_rss(spark, sf_dir):
    folder = flows.flow_folder(spark)
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
    about = F.concat(F.lit("About &lt;b&gt;"), F.col("p_type"), F.lit("&lt;/b&gt;  now"))
    title = F.concat("p_name", F.lit(" "), "p_partkey", F.lit(" - The Source"))
    item = tag("item", tag("title", title), tag("link", F.lit("http://x.org/"), F.col("p_partkey")), tag("source", F.col("p_brand")), tag("description", about), tag("pubDate", F.lit("Tue, 5 Mar 2024 10:00:00 GMT")))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>"))
    # Feeds of at most 100 items each, one to a file as they are fetched.
    feeds = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("feed")).agg(feed.alias("value"))
    feeds.write.partitionBy("feed").text(folder)
    return readers.rss(spark, folder)


@query("src_optional", "SELECT r_regionkey, r_name FROM region")
def src_optional(spark, sf_dir):
    there = readers.optional(spark, f"{sf_dir}/region.parquet", "r_regionkey int, r_name string")
    return there.unionByName(readers.optional(spark, f"{sf_dir}/no-such-table.parquet", "r_regionkey int, r_name string"))


@query("sink_version", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def sink_version(spark, sf_dir):
    """The pointer names the last version written."""
    table = flows.flow_folder(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_version(orders.where("o_orderstatus = 'F'"), table)
    sinks.write_version(orders.where("o_orderstatus <> 'P'"), table, ["o_orderstatus"])
    return sinks.read_current(spark, table)


@query("sink_quarantine", "SELECT rule_id, count(*) AS n_rows FROM (SELECT unnest([CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_quantity > 45 THEN 'quantity' END]) AS rule_id FROM lineitem) WHERE rule_id IS NOT NULL GROUP BY 1")
def sink_quarantine(spark, sf_dir):
    folder = flows.flow_folder(spark)
    rules = F.array_compact(F.array(F.when(F.col("l_discount") > 0.09, "discount"), F.when(F.col("l_quantity") > 45, "quantity")))
    sinks.quarantine(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(rules).alias("rule_id")), folder)
    return spark.read.parquet(folder).groupBy("rule_id").agg(F.count("*").alias("n_rows"))


@query("sink_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS priority FROM orders")
def sink_csv(spark, sf_dir):
    folder = flows.flow_folder(spark)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("done"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"))
    sinks.printed_csv(rows, folder)
    return readers.text_csv(spark, folder, ["k", "done", "priority"])


@query(
    "sink_upsert",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 > 0 THEN c_acctbal + 1 END AS balance,
    CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS seen FROM customer""",
)
def sink_upsert(spark, sf_dir):
    """New values replace, nulls do not, and the first sighting stays."""
    table, rows = flows.flow_folder(spark), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    sinks.upsert(rows.where("k % 2 = 0").select("k", F.col("c_acctbal").alias("balance"), F.lit("first").alias("seen")), table, ["k"], ("seen",))
    sinks.upsert(rows.select("k", F.when(F.col("k") % 3 > 0, F.col("c_acctbal") + 1).alias("balance"), F.lit("second").alias("seen")), table, ["k"], ("seen",))
    return sinks.read_current(spark, table)


_FIRST = "SELECT k, min(price) AS price FROM (SELECT o_custkey AS k, o_totalprice AS price, o_orderstatus AS s FROM orders) AS t WHERE s = 'F' GROUP BY k"


@query("sink_insert_once", f"WITH a AS ({_FIRST}) SELECT * FROM a UNION ALL SELECT o_custkey, min(o_totalprice) FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT k FROM a) GROUP BY 1")
def sink_insert_once(spark, sf_dir):
    path = flows.flow_folder(spark)
    for status in ("F", "O"):
        sinks.insert_once(read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price")), path, ["k"])
    return spark.read.parquet(path)


@query("sink_promote", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def sink_promote(spark, sf_dir):
    """Staged rows of approved keys, each inserted once though the load is repeated."""
    path = flows.flow_folder(spark)
    approved = read(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    staged = read(spark, sf_dir, "customer").join(approved, "c_nationkey").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    for _ in range(2):
        sinks.insert_once(staged, path, ["k"])
    return spark.read.parquet(path)


@query("sink_append_log", "SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, min(ts) FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1")
def sink_append_log(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    part = lambda cond: events.where(cond).select("user_id", "ts")
    return sinks.append_log(sinks.append_log(None, part("event_type = 'click'"), ["user_id"]), part("event_type <> 'click'"), ["user_id"])


@query("sink_audit", """SELECT event, payload FROM (VALUES ('load', '{"rows": 1}'), ('load', '{"rows": 2}'), ('publish', '{"by": "x", "rows": 3}')) AS t(event, payload)""")
def sink_audit(spark, sf_dir):
    path = flows.flow_folder(spark)
    sinks.audit(spark, path, "load", rows=1)
    sinks.audit(spark, path, "load", rows=2)
    sinks.audit(spark, path, "publish", rows=3, by="x")
    return spark.read.schema("event string, payload string").json(path)


@query("cut_asof", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1996-06-30' THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def cut_asof(spark, sf_dir):
    """Orders as known at a date: later ones gone, totals that were still accruing null."""
    rows = read(spark, sf_dir, "orders").withColumn("final", F.expr("o_orderdate + INTERVAL 90 DAYS"))
    return temporal.until(rows, "o_orderdate", F.lit("1996-06-30").cast("timestamp"), {"o_totalprice": "final"}).select("o_orderkey", "o_totalprice")


@query("serve_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND lower(o_orderpriority) LIKE '%high%' AND o_totalprice BETWEEN 50000 AND 300000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def serve_where(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    how = {"equal": {"o_orderstatus": "O", "o_custkey": None}, "like": {"o_orderpriority": "HIGH"}, "between": {"o_totalprice": (50000, 300000), "o_orderdate": (None, None)}, "among": {"o_custkey": rich}}
    return serving.where(read(spark, sf_dir, "orders"), **how).select("o_orderkey")


@query(
    "text_acronym_typo",
    """WITH t AS (SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' (ABC)' ELSE '' END) AS name, concat(CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, 'd', 't') ELSE p_name END, CASE WHEN p_partkey % 5 = 0 THEN '1' ELSE '' END) AS other, p_name FROM part)
    SELECT p_partkey, nullif(regexp_extract(name, '\\(([A-Z]{2,})\\)', 1), '') AS acronym, levenshtein(p_name, other) <= 2 AND regexp_replace(p_name, '[^0-9]', '', 'g') = regexp_replace(other, '[^0-9]', '', 'g') AND p_name <> other AS typo FROM t""",
)
def text_acronym_typo(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    other = F.concat(F.when(k % 2 == 0, F.replace(name, F.lit("d"), F.lit("t"))).otherwise(name), F.when(k % 5 == 0, "1").otherwise(""))
    return read(spark, sf_dir, "part").select(k, X.bracketed_acronym(F.concat(name, F.when(k % 3 == 0, " (ABC)").otherwise(""))).alias("acronym"), X.typo_only(name, other).alias("typo"))


@query(
    "text_progress",
    """SELECT p_partkey AS k, CASE WHEN p_size <= p_partkey + 1 THEN round(p_size / (p_partkey + 1.0), 9) END AS of_ha, CASE WHEN p_size <= 100 THEN round(p_size / 100.0, 9) END AS percent,
    p_size + 0.25 AS lo, p_size + 7.0 AS hi, CASE WHEN p_partkey % 2 = 0 THEN 'done' ELSE 'pending' END AS state FROM part""",
)
def text_progress(spark, sf_dir):
    """Shares, road stretches and states read from sentences."""
    k, n = F.col("p_partkey"), F.col("p_size")
    ha = F.concat(F.lit("acquired "), n, F.lit(" ha of "), k + 1, F.lit(" ha"))
    road = F.concat(F.lit("from km "), n, F.lit("+250 to km "), n + 7)
    land = F.concat(F.lit("Was completed before. Land: "), F.when(k % 2 == 0, "completed, later pending").otherwise("pending, not completed"))
    span = X.km_range(road)
    return read(spark, sf_dir, "part").select(
        k.alias("k"), F.round(X.share_done(ha), 9).alias("of_ha"), F.round(X.share_done(F.concat(n, F.lit(" % done"))), 9).alias("percent"), span["lo"].alias("lo"), span["hi"].alias("hi"),
        X.cue_state(land, "land:", [("done", "completed"), ("pending", "pending")]).alias("state"),
    )


@query("text_scrub", "SELECT c_custkey, concat('write to [email] or ', c_name) AS clean, concat('news of customer ', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS story FROM customer")
def text_scrub(spark, sf_dir):
    mail = F.concat(F.lit("write to a.b+"), F.col("c_custkey"), F.lit("@mail.example.org or "), F.col("c_name"))
    title = F.concat(F.lit("News of "), F.col("c_name"), F.lit(" - The Paper"))
    return read(spark, sf_dir, "customer").select("c_custkey", X.scrub_emails(mail).alias("clean"), X.story_key(title).alias("story"))


@query(
    "proj_loose_dates",
    """WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 20 YEAR AS o_orderdate FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN o_orderkey % 4 = 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN o_orderkey % 4 = 2 THEN CAST(o_orderdate AS DATE) END AS date,
    CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' END AS precision FROM o""",
)
def proj_loose_dates(spark, sf_dir):
    i, d = F.col("o_orderkey"), F.expr("o_orderdate + INTERVAL 20 YEARS")
    fmt = lambda f: F.date_format(d, f)
    month = F.when(i % 5 == 0, fmt("MM/yyyy")).when(i % 5 == 1, fmt("MMM-yy")).when(i % 5 == 2, fmt("yyyy-M")).when(i % 5 == 3, fmt("yyyy-MM-dd")).otherwise("soon")
    part = F.when(i % 4 == 0, fmt("yyyy")).when(i % 4 == 1, fmt("yyyy-MM")).when(i % 4 == 2, fmt("yyyy-MM-dd")).otherwise("2021-13")
    found = D.partial_date(part)
    return read(spark, sf_dir, "orders").select(i, D.loose_month(month, ("MM/yyyy", "MMM-yy", "yyyy-M", "yyyy-MM-dd")).alias("month"), found["date"].alias("date"), found["precision"].alias("precision"))


@query(
    "proj_scores",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 10 = 1 THEN 'infinity'::DOUBLE ELSE value END AS v, (event_id % 98 + 1) / 99.0 AS p FROM events)
    SELECT event_id, CASE WHEN NOT isnan(v) AND NOT isinf(v) THEN v END AS finite, round(1 / (1 + exp(-(0.5 * ln(p / (1 - p)) + 0.25))), 6) AS calibrated, round(pow(0.5, (event_id % 40) / 8.0), 9) AS weight,
    CASE event_id % 3 WHEN 0 THEN 'a;b;c' WHEN 1 THEN 'b;c' ELSE 'a;b' END AS notes FROM t""",
)
def proj_scores(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 10 == 0, F.lit(float("nan"))).when(i % 10 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    notes = S.union_tokens(F.when(i % 3 != 1, "a;b"), F.when(i % 3 != 2, "b;c").otherwise(""))
    p = F.least(F.greatest((i % 98 + 1) / 99.0, F.lit(1e-6)), F.lit(1 - 1e-6))
    return read(spark, sf_dir, "events").select(i, S.finite(v).alias("finite"), F.round(S.platt(p, 0.5, 0.25), 6).alias("calibrated"), F.round(S.age_weight((i % 40).cast("double"), 8.0), 9).alias("weight"), notes.alias("notes"))


@query(
    "flow_new_files",
    """WITH f AS (SELECT concat('f', event_id) AS path, CAST(event_id % 500 AS VARCHAR) AS sha256, ts AS modified FROM events WHERE event_id % 500 >= 100)
    SELECT arg_min(path, row(modified, path)) AS path, sha256, min(modified) AS modified FROM f GROUP BY sha256""",
)
def flow_new_files(spark, sf_dir):
    """Arrived files whose content and code version were not processed before."""
    files = read(spark, sf_dir, "events").select(F.concat(F.lit("f"), "event_id").alias("path"), (F.col("event_id") % 500).cast("string").alias("sha256"), F.lit("v1").alias("code_version"), F.col("ts").alias("modified"))
    done = spark.range(500).select(F.col("id").cast("string").alias("sha256"), F.when(F.col("id") < 100, "v1").otherwise("v0").alias("code_version"))
    return flows.new_files(files, done).select("path", "sha256", "modified")


@query("set_same_rows", "SELECT true AS same, false AS fewer")
def set_same_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return spark.createDataFrame([(relational.same_rows(orders, orders.repartition(3)), relational.same_rows(orders, orders.where("o_orderkey % 97 > 0")))], "same boolean, fewer boolean")
