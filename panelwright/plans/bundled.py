"""Bundles of every table's rows for all keys, summaries by scope, pulls that replace groups, reworded texts and dated facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import rules as R
from panelwright.operators import records, relational, summaries
from panelwright.plans.registry import query
from panelwright.sources.readers import optional
from panelwright.sources.tables import read

ASOF = "1998-12-31"


def _asof():
    return F.lit(ASOF).cast("timestamp")


def _aliases(spark, sf_dir):
    """Customers of one nation, segment and hundred of balance are one; the smallest names them."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alias"), F.min("c_custkey").over(w).alias("key"))


def _parts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    sources = orders.select("o_orderkey", "o_custkey").join(items, "o_orderkey").select("o_custkey", "l_suppkey").distinct()
    return [
        records.Part("master", read(spark, sf_dir, "customer"), "c_custkey", None, (F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))),
        records.Part("observations", orders, "o_custkey", F.col("o_orderdate"), (F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"))),
        records.Part("events", read(spark, sf_dir, "events"), "user_id", F.col("ts"), (F.col("event_id").alias("event"), F.col("event_type").alias("type"))),
        records.Part("provenance", sources, "o_custkey", None, (F.col("l_suppkey").alias("source"),)),
        records.Part("alerts", optional_rows(spark, f"{sf_dir}/alerts.parquet"), "key", F.col("at"), (F.col("row").alias("alert"),)),
    ]


def optional_rows(spark, path: str):
    """The table at path, None if it is missing."""
    found = optional(spark, path, records.ROWS)
    return found if found.take(1) else None


_BUNDLE = f"""a AS (SELECT c_custkey AS alias, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 100)) AS c FROM customer),
    u AS (SELECT 'master' AS part, c_custkey AS k, NULL::TIMESTAMP AS "at", CAST(to_json({{'name': c_name, 'segment': c_mktsegment}}) AS VARCHAR) AS row FROM customer
    UNION ALL SELECT 'observations', o_custkey, o_orderdate, CAST(to_json({{'order': o_orderkey, 'status': o_orderstatus}}) AS VARCHAR) FROM orders
    UNION ALL SELECT 'events', user_id, ts, CAST(to_json({{'event': event_id, 'type': event_type}}) AS VARCHAR) FROM events
    UNION ALL SELECT DISTINCT 'provenance', o_custkey, NULL::TIMESTAMP, CAST(to_json({{'source': l_suppkey}}) AS VARCHAR) FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    v AS (SELECT part, coalesce(c, k) AS key, "at", row FROM u LEFT JOIN a ON alias = k WHERE "at" IS NULL OR "at" <= TIMESTAMP '{ASOF}')"""


@query("serve_bundle_rows", f"""WITH {_BUNDLE} SELECT part, key, "at", row FROM v""")
def serve_bundle_rows(spark, sf_dir):
    """Every table's rows of each canonical key up to a day; a table that is missing adds none."""
    return records.bundle(_parts(spark, sf_dir), _aliases(spark, sf_dir), _asof())


@query(
    "serve_bundle_heads",
    f"""WITH {_BUNDLE}, g AS (SELECT DISTINCT c AS key, p AS part FROM a, unnest(['master', 'observations', 'events', 'provenance', 'alerts']) AS t(p)),
    h AS (SELECT key, part, count(*) AS n, min("at") AS first_at, max("at") AS last_at, arg_max(row, row(coalesce("at", TIMESTAMP '1800-01-01'), row)) AS latest FROM v GROUP BY 1, 2)
    SELECT key, part, part <> 'alerts' AS present, coalesce(n, 0) AS n, first_at, last_at, latest FROM g LEFT JOIN h USING (key, part)""",
)
def serve_bundle_heads(spark, sf_dir):
    """How many rows each part has of each canonical key, since when, and its latest row."""
    parts, aliases = _parts(spark, sf_dir), _aliases(spark, sf_dir)
    return records.heads(records.bundle(parts, aliases, _asof()), aliases.select("key"), parts)


_FACTS = f"""f AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{ASOF}' - INTERVAL 300 DAY) AS n_overdue, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS stage FROM orders WHERE o_orderdate <= TIMESTAMP '{ASOF}' GROUP BY 1),
    t AS (SELECT f.*, c_acctbal AS amount, n_regionkey AS scope, n_open > 0 AND stage <> 'O' AS silent FROM f JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey),
    s AS (SELECT * REPLACE (CAST(scope AS VARCHAR) AS scope) FROM t UNION ALL SELECT * REPLACE ('all' AS scope) FROM t)"""


def _facts(spark, sf_dir):
    """Each customer's open and overdue orders, the status of the last one, and whether that hides an open one."""
    orders = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= _asof())
    is_open = F.col("o_orderstatus") == "O"
    by = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(is_open).alias("n_open"), F.count_if(is_open & (F.col("o_orderdate") < _asof() - F.expr("interval 300 days"))).alias("n_overdue"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("stage")
    )
    place = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_acctbal").alias("amount"), F.col("n_regionkey").alias("scope"))
    return by.join(place, "c_custkey").withColumn("silent", (F.col("n_open") > 0) & (F.col("stage") != "O"))


@query("serve_linked_summary", f"WITH {_FACTS} SELECT scope, count(*) AS n_linked, count(*) FILTER (WHERE n_open > 0) AS n_open, count(*) FILTER (WHERE n_overdue > 0) AS n_overdue, count(*) FILTER (WHERE silent) AS n_silent, coalesce(round(sum(amount) FILTER (WHERE n_open > 0), 1), 0) AS open_amount FROM s GROUP BY 1")
def serve_linked_summary(spark, sf_dir):
    return summaries.linked(_facts(spark, sf_dir), "scope", "amount")


@query("serve_stage_shares", f"WITH {_FACTS} SELECT scope, stage, count(*) AS n FROM s GROUP BY 1, 2")
def serve_stage_shares(spark, sf_dir):
    return summaries.shares(_facts(spark, sf_dir), "scope", "stage")


@query("serve_top_overdue", f"WITH {_FACTS} SELECT scope, k AS c_custkey, amount, CAST(row_number() OVER (PARTITION BY scope ORDER BY amount DESC NULLS LAST, k) AS INTEGER) AS place FROM s WHERE n_overdue > 0 QUALIFY place <= 5")
def serve_top_overdue(spark, sf_dir):
    """The five overdue keys of each scope with the largest amounts."""
    return summaries.overdue(_facts(spark, sf_dir), "scope", "c_custkey", "amount", 5)


@query(
    "serve_link_coverage",
    """WITH l AS (SELECT l_shipdate, l_returnflag AS method, CASE WHEN l_quantity > 25 THEN l_linestatus = 'O' END AS ok, CAST(l_suppkey % 7 AS VARCHAR) AS scope FROM lineitem), s AS (SELECT * FROM l UNION ALL SELECT * REPLACE ('all' AS scope) FROM l),
    g AS (SELECT scope, method, count(*) AS n, count(ok) AS judged, count(*) FILTER (WHERE ok) AS correct FROM s GROUP BY 1, 2), p AS (SELECT *, correct / judged AS p, 1 + 3.8416 / judged AS d FROM g)
    SELECT scope, method, n, judged, correct, round((p + 1.9208 / judged) / d - 1.96 * sqrt(p * (1 - p) / judged + 0.9604 / (judged * judged)) / d, 3) AS lo, round((p + 1.9208 / judged) / d + 1.96 * sqrt(p * (1 - p) / judged + 0.9604 / (judged * judged)) / d, 3) AS hi FROM p""",
)
def serve_link_coverage(spark, sf_dir):
    """How many links each method made, and the share of the judged ones that are right, with its interval."""
    links = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus") == "O").alias("ok"), (F.col("l_suppkey") % 7).alias("scope"))
    return summaries.coverage(links, "scope", "method", F.col("ok"))


@query(
    "set_newest_pull",
    """WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, year(o_orderdate) AS y FROM orders), p AS (SELECT * FROM o WHERE y >= 1999 AND o_custkey % 3 > 0), b AS (SELECT * FROM o WHERE y < 1999),
    n AS (SELECT o_custkey, max(y) AS m FROM p GROUP BY 1), u AS (SELECT 0 AS r, p.o_custkey, o_orderpriority, o_orderkey FROM p JOIN n ON n.o_custkey = p.o_custkey AND m = y UNION ALL SELECT 1, o_custkey, o_orderpriority, o_orderkey FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM n))
    SELECT o_custkey, o_orderpriority, o_orderkey FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY r, o_orderkey) = 1""",
)
def set_newest_pull(spark, sf_dir):
    """Customers whose newest yearly pull replaces what was there before, whole; one row a priority."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.year("o_orderdate").alias("y"))
    return relational.newest_pull(rows.where("y < 1999"), rows.where("y >= 1999 AND o_custkey % 3 > 0"), "o_custkey", "y", ["o_custkey", "o_orderpriority"], ["o_orderkey"])


BANDS = ((50.0, "few"), (1000.0, "some"), (1e9, "many"))


@query(
    "text_reworded",
    """WITH t AS (SELECT doc_id, text, string_split_regex(text, '[0-9]+(?:[.][0-9]+)?') AS a, [CASE WHEN x < 50 THEN 'few' WHEN x < 1000 THEN 'some' WHEN x < 1e9 THEN 'many' ELSE 'countless' END FOR x IN [CAST(y AS DOUBLE) FOR y IN regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')]] AS w FROM documents),
    r AS (SELECT doc_id, text, array_to_string([z[1] || coalesce(z[2], '') FOR z IN list_zip(a, w)], '') AS s FROM t)
    SELECT doc_id, sha256(CASE WHEN text IS NOT NULL THEN regexp_replace(s, '[#%&$]{2,}', '', 'g') END) AS sha, length(CASE WHEN text IS NOT NULL THEN regexp_replace(s, '[#%&$]{2,}', '', 'g') END) AS n FROM r""",
)
def text_reworded(spark, sf_dir):
    """Every number of a text as the word of its band, and runs of symbols gone."""
    told = R.reworded(F.col("text"), [(r"([0-9]+(?:[.][0-9]+)?)", lambda x: R.banded(x.cast("double"), BANDS, "countless"))], ("[#%&$]{2,}",))
    return read(spark, sf_dir, "documents").select("doc_id", told.alias("s")).select("doc_id", F.sha2("s", 256).alias("sha"), F.length("s").alias("n"))


@query(
    "serve_fact_rows",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, o_orderdate AS pub, CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%Y-%m') WHEN 'N' THEN strftime(l_shipdate, '%Y') WHEN 'R' THEN strftime(l_shipdate, '%Y-%m-%d') END AS ev, CASE l_returnflag WHEN 'A' THEN date_trunc('month', l_shipdate) WHEN 'N' THEN date_trunc('year', l_shipdate) ELSE l_shipdate END AS d, CASE l_returnflag WHEN 'A' THEN 'month' WHEN 'N' THEN 'year' ELSE 'day' END AS pr FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    x AS (SELECT *, CAST(d AS DATE) > CAST(pub AS DATE) AS late FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN NOT late THEN CAST(d AS DATE) END AS event_date, CASE WHEN NOT late THEN pr END AS precision, late AS stands_in,
    CASE WHEN late THEN CAST(pub AS DATE) ELSE CAST(d AS DATE) END > DATE '{ASOF}' - INTERVAL 18 MONTH AND CASE WHEN late THEN CAST(pub AS DATE) ELSE CAST(d AS DATE) END <= DATE '{ASOF}' AS live FROM x""",
)
def serve_fact_rows(spark, sf_dir):
    """Shipments as reported events: a date after the report is a plan, so the day of the report stands in."""
    form = lambda f: F.date_format("l_shipdate", f)
    told = F.when(F.col("l_returnflag") == "A", form("yyyy-MM")).when(F.col("l_returnflag") == "N", form("yyyy")).otherwise(form("yyyy-MM-dd"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    fact = R.dated_fact(F.col("o_orderdate"), told, _asof(), 18)
    return read(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", fact.alias("f")).select("l_orderkey", "l_linenumber", "f.*")
