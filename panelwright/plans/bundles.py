"""Composites: road and name rules, cards and mentions, rulebook, proposals, research, candidate features and scorecards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.functions.dates import calendar_months_between
from panelwright.functions.scalars import clip, ratio
from panelwright.operators import temporal
from panelwright.plans.panel import PANEL_SQL, labels, panel
from panelwright.plans.registry import query
from panelwright.sources.tables import read

ASOF = "1997-06-30"


def _asof():
    return F.lit(ASOF).cast("timestamp")


@query(
    "text_road_ids",
    r"""WITH t AS (SELECT p_partkey, upper(CASE p_partkey % 5 WHEN 0 THEN 'Widening of NH-0' || p_size || ' and nh ' || p_partkey % 7 || 'a' WHEN 1 THEN 'new NH ' || p_size || ' (old NH-' || p_partkey % 9 || ') from NH 8'
      WHEN 2 THEN 'junction nh' || p_size || ' to N.H. 4' WHEN 3 THEN p_name ELSE 'NH 7, erstwhile NH.' || p_size || '; NH 7' END) AS s FROM part),
    e AS (SELECT p_partkey, unnest(regexp_extract_all(s, '(?:\b(?:NEW|OLD|ERSTWHILE|JUNCTION)\W+)?\bNH[\s.-]*0*[1-9]\d{0,2}[A-Z]?\b')) AS m FROM t),
    g AS (SELECT p_partkey, regexp_extract(m, '^(NEW|OLD|ERSTWHILE|JUNCTION)', 1) AS tag, regexp_extract(m, 'NH[\s.-]*0*([1-9]\d{0,2}[A-Z]?)$', 1) AS id FROM e),
    n AS (SELECT *, bool_or(tag = 'NEW') OVER (PARTITION BY p_partkey) AS new FROM g)
    SELECT part.p_partkey, x.roads FROM part LEFT JOIN (SELECT p_partkey, string_agg(DISTINCT id, ';' ORDER BY id) AS roads FROM n WHERE tag = 'NEW' OR (tag = '' AND NOT new) GROUP BY 1) x ON x.p_partkey = part.p_partkey""",
)
def text_road_ids(spark, sf_dir):
    """Road numbers named in project titles."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    title = (
        F.when(i % 5 == 0, F.concat(F.lit("Widening of NH-0"), size, F.lit(" and nh "), (i % 7).cast("string"), F.lit("a")))
        .when(i % 5 == 1, F.concat(F.lit("new NH "), size, F.lit(" (old NH-"), (i % 9).cast("string"), F.lit(") from NH 8")))
        .when(i % 5 == 2, F.concat(F.lit("junction nh"), size, F.lit(" to N.H. 4")))
        .when(i % 5 == 3, F.col("p_name"))
        .otherwise(F.concat(F.lit("NH 7, erstwhile NH."), size, F.lit("; NH 7")))
    )
    return read(spark, sf_dir, "part").select("p_partkey", T.road_ids(title).alias("roads"))


@query(
    "text_name_profile",
    r"""WITH t AS (SELECT *, regexp_matches(p_name, 'ring|pipe') OR p_type = 'STANDARD' OR (NOT regexp_matches(p_name, 'box|plate') AND p_type IN ('ECONOMY', 'PROMO')) AS l FROM part)
    SELECT p_partkey, l AS linear, regexp_matches(p_type, 'MEDIUM') OR (regexp_matches(p_name, '\bwidget') AND NOT l) AS mining FROM t""",
)
def text_name_profile(spark, sf_dir):
    """Line or not, and mine or not, from group and name."""
    linear = T.is_linear(F.col("p_type"), F.col("p_name"), ["STANDARD"], ["ECONOMY", "PROMO"], "ring|pipe", "box|plate")
    mining = F.col("p_type").rlike("MEDIUM") | (F.col("p_name").rlike(r"\bwidget") & ~linear)
    return read(spark, sf_dir, "part").select("p_partkey", linear.alias("linear"), mining.alias("mining"))


ALIASES = {"BUILDING WORKS": "BW", "MACHINERY WORKS": "MW", "MACHINERY WORKS DIVISION": "MWD"}


@query(
    "text_canonical",
    r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'The ' || c_mktsegment || ' Works Ltd. II' WHEN 2 THEN c_mktsegment || ' Works Group (' || left(c_mktsegment, 3) || ')'
      WHEN 3 THEN 'BW for unit ' || c_custkey % 10 WHEN 4 THEN c_mktsegment || ' Works Division of ' || c_nationkey WHEN 5 THEN 'Invalid Co' ELSE c_mktsegment || ' & Sons' END AS raw FROM customer),
    m AS (SELECT *, regexp_replace(trim(regexp_replace(replace(upper(raw), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), '^THE | LTD\b', '', 'g') AS s0 FROM t),
    n AS (SELECT *, regexp_replace(s0, '( (I|II|III|IV))+$', '') AS s, regexp_extract(raw, '\(([A-Z]{2,10})\)', 1) AS code FROM m)
    SELECT c_custkey, CASE WHEN raw IS NULL OR s = 'INVALID CO' THEN NULL WHEN s = 'BUILDING WORKS' THEN 'BW' WHEN s = 'MACHINERY WORKS' THEN 'MW' WHEN code <> '' THEN code WHEN s LIKE 'BW FOR %' THEN 'BW'
      WHEN s LIKE 'MACHINERY WORKS DIVISION %' THEN 'MWD' WHEN s LIKE 'MACHINERY WORKS %' THEN 'MW' WHEN s LIKE 'BUILDING WORKS %' THEN 'BW' ELSE s END AS name,
      CASE WHEN raw IS NULL THEN 'missing' WHEN s = 'INVALID CO' THEN 'invalid' WHEN s IN ('BUILDING WORKS', 'MACHINERY WORKS') THEN 'alias' WHEN code <> '' THEN 'bracket' WHEN s LIKE 'BW FOR %' THEN 'prefix'
      WHEN s LIKE 'MACHINERY WORKS %' OR s LIKE 'BUILDING WORKS %' THEN 'alias_prefix' ELSE 'normalised' END AS rule FROM n""",
)
def text_canonical(spark, sf_dir):
    """Printed agency names to canonical ones by a cascade of rules."""
    i, seg = F.col("c_custkey"), F.col("c_mktsegment")
    raw = (
        F.when(i % 7 == 0, F.lit(None).cast("string"))
        .when(i % 7 == 1, F.concat(F.lit("The "), seg, F.lit(" Works Ltd. II")))
        .when(i % 7 == 2, F.concat(seg, F.lit(" Works Group ("), F.left(seg, F.lit(3)), F.lit(")")))
        .when(i % 7 == 3, F.concat(F.lit("BW for unit "), (i % 10).cast("string")))
        .when(i % 7 == 4, F.concat(seg, F.lit(" Works Division of "), F.col("c_nationkey").cast("string")))
        .when(i % 7 == 5, F.lit("Invalid Co"))
        .otherwise(F.concat(seg, F.lit(" & Sons")))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", T.canonical(raw, ALIASES, ("LTD", "THE"), ("INVALID CO",)).alias("r")).select("c_custkey", "r.*")


@query(
    "rag_cards",
    """SELECT 'card' AS kind, concat('C', c_custkey) AS chunk_id, c_custkey AS owner, c_name AS title, concat_ws('. ', 'Segment ' || c_mktsegment, 'Nation ' || n_name, CASE WHEN c_acctbal < 0 THEN 'Account overdrawn' END) AS body FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'event', concat('O', o_orderkey), o_custkey, 'Order ' || o_orderkey, concat_ws('. ', 'Placed ' || strftime(o_orderdate, '%Y-%m-%d'), 'Priority ' || o_orderpriority) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'doc', concat('B', item_id), NULL, 'Passage ' || item_id, text FROM benchmark""",
)
def rag_cards(spark, sf_dir):
    """Retrieval chunks of every kind: a card for each key, its open events, and documents that belong to no key."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    at = lambda c: F.col(c).cast("string")
    cards = read(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.lit("card").alias("kind"), F.concat(F.lit("C"), at("c_custkey")).alias("chunk_id"), F.col("c_custkey").alias("owner"), F.col("c_name").alias("title"),
        F.concat_ws(". ", F.concat(F.lit("Segment "), "c_mktsegment"), F.concat(F.lit("Nation "), "n_name"), F.when(F.col("c_acctbal") < 0, "Account overdrawn")).alias("body"),
    )
    events = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.lit("event").alias("kind"), F.concat(F.lit("O"), at("o_orderkey")).alias("chunk_id"), F.col("o_custkey").alias("owner"), F.concat(F.lit("Order "), at("o_orderkey")).alias("title"),
        F.concat_ws(". ", F.concat(F.lit("Placed "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Priority "), "o_orderpriority")).alias("body"),
    )
    docs = read(spark, sf_dir, "benchmark").select(
        F.lit("doc").alias("kind"), F.concat(F.lit("B"), at("item_id")).alias("chunk_id"), F.lit(None).cast("long").alias("owner"), F.concat(F.lit("Passage "), at("item_id")).alias("title"), F.col("text").alias("body")
    )
    return cards.unionByName(events).unionByName(docs)


@query(
    "rag_mentions",
    r"""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS owner, 'Customer#' || o_custkey || ' before Customer#' || (o_custkey + o_orderkey) % 100 || ', FP/' || o_orderkey % 60 || ' and FP/' || o_orderkey % 7 AS body FROM orders),
    p AS (SELECT 'FP/' || c_custkey % 50 AS no, c_custkey AS k FROM customer WHERE c_nationkey = 3),
    m AS (SELECT id, owner, CAST(unnest(regexp_extract_all(body, 'Customer#(\d+)', 1)) AS BIGINT) AS k FROM c
      UNION SELECT id, owner, p.k FROM (SELECT id, owner, unnest(regexp_extract_all(body, 'FP/\d+')) AS no FROM c WHERE owner IS NULL) JOIN p USING (no))
    SELECT c.id, x.mentions FROM c LEFT JOIN (SELECT id, string_agg(DISTINCT k::VARCHAR, ' ' ORDER BY k::VARCHAR) AS mentions FROM m WHERE owner IS NULL OR k <> owner GROUP BY 1) x ON x.id = c.id""",
)
def rag_mentions(spark, sf_dir):
    """Keys other than its own that a chunk names, by key or, in a chunk without an owner, by a linked proposal."""
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    body = F.concat(F.lit("Customer#"), s(k), F.lit(" before Customer#"), s((k + i) % 100), F.lit(", FP/"), s(i % 60), F.lit(" and FP/"), s(i % 7))
    chunks = read(spark, sf_dir, "orders").select(i.alias("id"), F.when(i % 4 > 0, k).alias("owner"), body.alias("body"))
    links = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("FP/"), s(F.col("c_custkey") % 50)).alias("no"), s(F.col("c_custkey")).alias("k"))
    # Keys are gathered once for each set of proposals that chunks name, not for each chunk: a chunk meets them by the set, and no key is shuffled with it.
    nos = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(r"FP/\d+"), F.lit(0)))), " ")
    chunks = chunks.withColumn("nos", F.when(F.col("owner").isNull(), nos))
    sets = chunks.where("nos <> ''").select("nos").distinct()
    by_set = sets.select("nos", F.explode(F.split("nos", " ")).alias("no")).join(links, "no").groupBy("nos").agg(F.sort_array(F.collect_set("k")).alias("more"))
    named = F.regexp_extract_all("body", F.lit(r"Customer#(\d+)"), F.lit(1))
    all_keys = F.array_union(named, F.coalesce("more", F.array().cast("array<string>")))
    others = F.when(F.col("owner").isNull(), all_keys).otherwise(F.array_remove(all_keys, F.coalesce(s(F.col("owner")), F.lit(""))))
    return chunks.join(by_set, "nos", "left").select("id", F.when(F.size(others) > 0, F.array_join(F.sort_array(others), " ")).alias("mentions"))


#: Scenario, whether for lines, least size, size it ends before, level and name of the authority, complexity.
RULEBOOK = [("S1", True, 0, 10, 1, "regional", 2), ("S2", True, 5, 30, 2, "state", 4), ("S3", True, 30, 99, 3, "central", 7), ("S4", False, 0, 20, 2, "state", 5), ("S5", False, 20, 99, 3, "central", 9), ("S6", False, 0, 99, 1, "regional", 3)]
_RULE_NAMES = ["scenario", "line", "lo", "hi", "level", "authority", "points"]


@query(
    "panel_rulebook",
    f"""WITH r({', '.join(_RULE_NAMES)}) AS (VALUES {', '.join(str(r).replace('True', 'true').replace('False', 'false') for r in RULEBOOK)}),
    t AS (SELECT p_partkey, regexp_matches(p_name, 'ring|pipe') AS line, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS size FROM part),
    m AS (SELECT p_partkey, r.* FROM t JOIN r ON r.line = t.line AND (size IS NULL OR (size >= lo AND size < hi)))
    SELECT t.p_partkey, median(points) AS expected, max(points) AS worst, min(level) AS least_level, max(level) AS most_level, arg_max(authority, row(points, level, scenario)) AS authority, string_agg(scenario, ';' ORDER BY scenario) AS scenarios
    FROM t LEFT JOIN m ON m.p_partkey = t.p_partkey GROUP BY 1""",
)
def panel_rulebook(spark, sf_dir):
    """Expected and worst complexity of a project from the scenarios of a rulebook that its profile matches. Rules are matched
    once a distinct profile; an unknown size matches every band."""
    rules = spark.createDataFrame(RULEBOOK, "scenario string, rule_line boolean, lo int, hi int, level int, authority string, points int")
    size = F.when(F.col("p_partkey") % 3 > 0, F.col("p_size"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").rlike("ring|pipe").alias("line"), size.alias("size"))
    profiles = rows.select("line", "size").distinct()
    fits = (F.col("rule_line") == F.col("line")) & (F.col("size").isNull() | ((F.col("size") >= F.col("lo")) & (F.col("size") < F.col("hi"))))
    found = profiles.join(F.broadcast(rules), fits, "left").groupBy("line", "size").agg(  # six rules
        F.percentile("points", 0.5).alias("expected"),
        F.max("points").alias("worst"),
        F.min("level").alias("least_level"),
        F.max("level").alias("most_level"),
        F.max_by("authority", F.struct("points", "level", "scenario")).alias("authority"),
        F.array_join(F.array_sort(F.collect_list("scenario")), ";").alias("scenarios"),
    )
    same = rows["line"].eqNullSafe(found["line"]) & rows["size"].eqNullSafe(found["size"])
    return rows.join(found, same, "left").select("p_partkey", "expected", "worst", "least_level", "most_level", "authority", F.when(F.col("scenarios") != "", F.col("scenarios")).alias("scenarios"))


_PROPOSALS_SQL = f"""d AS (SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS s1, max(l_shipdate) AS s2 FROM lineitem GROUP BY 1),
    p AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 3 WHEN s2 <= TIMESTAMP '{ASOF}' THEN 4 WHEN s1 <= TIMESTAMP '{ASOF}' THEN 2 ELSE 1 END AS stage,
      datediff('day', CASE WHEN o_orderstatus = 'P' THEN NULL WHEN s2 <= TIMESTAMP '{ASOF}' THEN s2 WHEN s1 <= TIMESTAMP '{ASOF}' THEN s1 ELSE o_orderdate END, TIMESTAMP '{ASOF}') AS days, o_orderdate AS received,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 30 ELSE 90 END AS norm FROM orders LEFT JOIN d USING (o_orderkey) WHERE o_orderdate <= TIMESTAMP '{ASOF}')"""


def proposals(spark, sf_dir):
    """Proposals known at a date: the stage reached (1 received, 2 first step, 3 dropped, 4 final), the days in it, the norm."""
    steps = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s1"), F.max("l_shipdate").alias("s2"))
    rows = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= _asof()).join(steps, "o_orderkey", "left")
    gone, last, first = F.col("o_orderstatus") == "P", F.col("s2") <= _asof(), F.col("s1") <= _asof()
    since = F.when(gone, None).when(last, F.col("s2")).when(first, F.col("s1")).otherwise(F.col("o_orderdate"))
    return rows.select(
        F.col("o_custkey").alias("k"),
        F.col("o_orderkey").alias("id"),
        F.when(gone, 3).when(last, 4).when(first, 2).otherwise(1).alias("stage"),
        F.datediff(_asof(), since).alias("days"),
        F.col("o_orderdate").alias("received"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 30).otherwise(90).alias("norm"),
    )


@query("panel_proposals", f"WITH {_PROPOSALS_SQL} SELECT k, id, stage, days, norm, stage <= 2 AND days > norm AS overdue FROM p")
def panel_proposals(spark, sf_dir):
    """Stage, time in it and overdue flag of each proposal at a date."""
    return proposals(spark, sf_dir).select("k", "id", "stage", "days", "norm", ((F.col("stage") <= 2) & (F.col("days") > F.col("norm"))).alias("overdue"))


@query(
    "panel_proposal_rollup",
    f"""WITH {_PROPOSALS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stage, days DESC NULLS LAST, id) AS rn FROM p)
    SELECT k, count(*) AS n, count(*) FILTER (WHERE stage <= 2) AS n_open, count(*) FILTER (WHERE stage = 2) AS n_first_step, count(*) FILTER (WHERE stage = 3) AS n_dropped, count(*) FILTER (WHERE stage = 4) AS n_final, count(*) FILTER (WHERE stage <= 2 AND days > norm) AS n_overdue,
      max(stage) FILTER (WHERE rn = 1) AS stage, max(days) FILTER (WHERE rn = 1) AS days, min(received) FILTER (WHERE stage <= 2) AS oldest_open,
      concat_ws(' | ', string_agg('O' || id, ' | ' ORDER BY rn) FILTER (WHERE rn <= 3), CASE WHEN count(*) > 3 THEN 'and ' || count(*) - 3 || ' more' END) AS evidence FROM n GROUP BY k""",
)
def panel_proposal_rollup(spark, sf_dir):
    """Proposals by project: counts by stage, the least advanced one that is longest in its stage, and evidence of three."""
    w = Window.partitionBy("k").orderBy("stage", F.col("days").desc_nulls_last(), "id")
    rows = proposals(spark, sf_dir).withColumn("rn", F.row_number().over(w))
    is_open, top = F.col("stage") <= 2, F.col("rn") == 1
    shown = F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", F.concat(F.lit("O"), F.col("id").cast("string")).alias("o"))))
    by = rows.groupBy("k").agg(
        F.count("*").alias("n"),
        F.count_if(is_open).alias("n_open"),
        F.count_if(F.col("stage") == 2).alias("n_first_step"),
        F.count_if(F.col("stage") == 3).alias("n_dropped"),
        F.count_if(F.col("stage") == 4).alias("n_final"),
        F.count_if(is_open & (F.col("days") > F.col("norm"))).alias("n_overdue"),
        F.max(F.when(top, F.col("stage"))).alias("stage"),
        F.max(F.when(top, F.col("days"))).alias("days"),
        F.min(F.when(is_open, F.col("received"))).alias("oldest_open"),
        F.transform(F.array_sort(shown), lambda x: x["o"]).alias("shown"),
    )
    more = F.when(F.col("n") > 3, F.concat(F.lit("and "), (F.col("n") - 3).cast("string"), F.lit(" more")))
    return by.withColumn("evidence", F.concat_ws(" | ", "shown", more)).drop("shown")


@query(
    "agg_research_summary",
    """WITH now AS (SELECT max(ts) - INTERVAL 10 DAY AS since FROM events), f AS (SELECT c_mktsegment AS state, user_id, event_type IN ('error', 'signup') AND ts > since AS live FROM events CROSS JOIN now LEFT JOIN customer ON c_custkey = user_id)
    SELECT CASE WHEN grouping(state) = 1 THEN 'all' ELSE coalesce(state, 'unknown') END AS state, count(*) AS n_facts, count(DISTINCT user_id) AS n_with_facts, count(*) FILTER (WHERE live) AS n_live, count(DISTINCT user_id) FILTER (WHERE live) AS n_keys_live FROM f GROUP BY GROUPING SETS ((state), ())""",
)
def agg_research_summary(spark, sf_dir):
    """Facts and live negative ones by state and overall, with the keys they concern."""
    events = read(spark, sf_dir, "events")
    since = F.broadcast(events.agg((F.max("ts") - F.expr("interval 10 days")).alias("since")))  # one row
    state = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("state"))
    live = F.col("event_type").isin("error", "signup") & (F.col("ts") > F.col("since"))
    facts = events.crossJoin(since).select("user_id", live.alias("live")).join(state, "user_id", "left")
    by = facts.groupingSets([["state"], []], "state").agg(
        F.grouping("state").alias("g"), F.count("*").alias("n_facts"), F.count_distinct("user_id").alias("n_with_facts"), F.count_if("live").alias("n_live"), F.count_distinct(F.when(F.col("live"), F.col("user_id"))).alias("n_keys_live")
    )
    return by.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("state", F.lit("unknown"))).alias("state"), "n_facts", "n_with_facts", "n_live", "n_keys_live")


@query(
    "ml_feasibility",
    f"""WITH {PANEL_SQL}, f AS (SELECT a.k, a.q, a.x, datediff('month', a.at, TIMESTAMP '2001-06-30') AS left_months, (a.x - arg_max(b.x, b.q)) / (a.q - max(b.q)) AS v FROM panel a LEFT JOIN panel b ON a.k = b.k AND b.q BETWEEN a.q - 4 AND a.q - 2 AND b.x IS NOT NULL GROUP BY a.k, a.q, a.x, a.at),
    g AS (SELECT *, greatest(500000 - x, 0) AS todo, greatest(left_months / 3, 1 / 3) AS q_left FROM f)
    SELECT k, q, todo / q_left AS required_pace, CASE WHEN v IS NOT NULL THEN least(todo / q_left / greatest(v, 1000), 100) END AS pace_ratio, todo / q_left - v AS pace_gap,
      CASE WHEN v IS NOT NULL THEN least(greatest(todo / greatest(v, 1000) * 3 - left_months, -120), 240) END AS projected_overrun, left_months <= 6 AS due_in_2q, left_months <= 12 AS due_in_4q FROM g""",
)
def ml_feasibility(spark, sf_dir):
    """Deadline feasibility: the pace needed against the recent one, months late at that pace, and nearness of the deadline."""
    left = calendar_months_between(F.col("at"), F.lit("2001-06-30").cast("timestamp"))
    rows = panel(spark, sf_dir).select("k", "q", F.greatest(500000 - F.col("x"), F.lit(0)).alias("todo"), left.alias("left"), temporal.velocity(F.col("x"), ["k"], "q", 2, 2).alias("v"))
    need = F.col("todo") / F.greatest(F.col("left") / 3, F.lit(1 / 3))
    pace, known = F.greatest("v", F.lit(1000.0)), F.col("v").isNotNull()
    return rows.select(
        "k",
        "q",
        need.alias("required_pace"),
        F.when(known, F.least(need / pace, F.lit(100.0))).alias("pace_ratio"),
        (need - F.col("v")).alias("pace_gap"),
        F.when(known, clip(F.col("todo") / pace * 3 - F.col("left"), -120.0, 240.0)).alias("projected_overrun"),
        (F.col("left") <= 6).alias("due_in_2q"),
        (F.col("left") <= 12).alias("due_in_4q"),
    )


@query(
    "ml_slip_history",
    f"""WITH {PANEL_SQL}, s AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY q) AS p FROM panel), e AS (SELECT *, CASE WHEN x > p THEN x - p END AS push FROM s)
    SELECT k, q, last_value(push IGNORE NULLS) OVER (PARTITION BY k ORDER BY q) AS last_push, count(push) OVER (PARTITION BY k ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS pushes_4q,
      count(push) OVER (PARTITION BY k ORDER BY q RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS pushes_8q, count(p) OVER h AS own_n, round(count(push) OVER h / nullif(count(p) OVER h, 0), 9) AS own_rate
    FROM e WINDOW h AS (PARTITION BY k ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)""",
)
def ml_slip_history(spark, sf_dir):
    """A key's history at a quarter: its last push, pushes of 4 and 8 quarters, and its own rate among outcomes known by then."""
    w = Window.partitionBy("k").orderBy("q")
    past = w.rangeBetween(Window.unboundedPreceding, -2)
    rows = panel(spark, sf_dir).select("k", "q", "x", F.lag("x").over(w).alias("p")).withColumn("push", F.when(F.col("x") > F.col("p"), F.col("x") - F.col("p")))
    n = F.count("p").over(past)
    return rows.select(
        "k",
        "q",
        F.last("push", True).over(w).alias("last_push"),
        F.count("push").over(w.rangeBetween(-3, 0)).alias("pushes_4q"),
        F.count("push").over(w.rangeBetween(-7, 0)).alias("pushes_8q"),
        n.alias("own_n"),
        F.round(F.when(n > 0, F.count("push").over(past) / n), 9).alias("own_rate"),
    )


NAME_TYPES = {"ring": r"\bring\b", "colour": "red|blue|green", "small": "small|mini", "widget": "widget|gadget", "box": r"\bbox(es)?\b"}


@query("ml_name_flags", f"SELECT p_partkey, {', '.join(f'''regexp_matches(lower(p_name), '{p}')::INT AS name_{k}''' for k, p in NAME_TYPES.items())} FROM part")
def ml_name_flags(spark, sf_dir):
    """One 0 or 1 column for each group of name keywords."""
    name = F.lower(F.coalesce("p_name", F.lit("")))
    return read(spark, sf_dir, "part").select("p_partkey", *[name.rlike(p).cast("int").alias(f"name_{k}") for k, p in NAME_TYPES.items()])


@query(
    "label_summary",
    " UNION ALL ".join(
        f"""SELECT {h} AS h, count(*) AS n, count(y_rise) AS n_rise, round(avg(y_rise::INT), 9) AS rate_rise, count(y_finish) AS n_finish, round(avg(y_finish::INT), 9) AS rate_finish FROM (WITH {PANEL_SQL}
        SELECT CASE WHEN a.x > 0 THEN b.x >= 1.05 * a.x END AS y_rise, CASE WHEN NOT a.done THEN b.done END AS y_finish FROM panel a JOIN panel b ON a.k = b.k AND b.q = a.q + {h})"""
        for h in (1, 2, 4)
    ),
)
def label_summary(spark, sf_dir):
    """Labelled rows and rates by horizon."""
    rows, out = panel(spark, sf_dir), None
    for h in (1, 2, 4):
        y = labels(rows, h)
        rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 9)
        one = y.agg(F.count("*").alias("n"), F.count("y_rise").alias("n_rise"), rate("y_rise").alias("rate_rise"), F.count("y_finish").alias("n_finish"), rate("y_finish").alias("rate_finish")).select(F.lit(h).alias("h"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "serve_scorecard",
    """WITH o AS (SELECT c_nationkey AS a, o_totalprice AS x FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'),
    g AS (SELECT a, count(*) AS n_open, sum(x) AS capital, count(*) FILTER (WHERE x >= 450000) AS n_critical, count(*) FILTER (WHERE x >= 350000 AND x < 450000) AS n_high FROM o GROUP BY 1)
    SELECT n_name AS agency, n_open, round(capital, 2) AS capital, n_critical, n_high, row_number() OVER (ORDER BY round(capital, 2) DESC, n_name) AS rank FROM g JOIN nation ON n_nationkey = a QUALIFY rank <= 8""",
)
def serve_scorecard(spark, sf_dir):
    """The eight agencies with the largest open capital, with their open, critical and high counts."""
    agency = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    x = F.col("o_totalprice")
    by = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(agency, "o_custkey").groupBy("n_nationkey").agg(
        F.count("*").alias("n_open"), F.round(F.sum(x), 2).alias("capital"), F.count_if(x >= 450000).alias("n_critical"), F.count_if((x >= 350000) & (x < 450000)).alias("n_high")
    )
    named = by.join(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("agency")), "n_nationkey")
    rank = F.row_number().over(Window.orderBy(F.col("capital").desc(), "agency"))  # one row an agency
    return named.orderBy(F.col("capital").desc(), "agency").limit(8).select("agency", "n_open", "capital", "n_critical", "n_high", rank.alias("rank"))


@query(
    "serve_external_scope",
    f"""SELECT n_regionkey AS scope, count(*) AS n_keys, count(*) FILTER (WHERE o.n_open > 0) AS n_with_open, coalesce(CAST(sum(o.n_open) AS BIGINT), 0) AS n_open, count(*) FILTER (WHERE o.last > TIMESTAMP '{ASOF}' - INTERVAL 6 MONTH) AS n_current, arg_max(c_custkey, row(coalesce(o.n_open, 0), -c_custkey)) AS worst_key
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, max(o_orderdate) AS last FROM orders WHERE o_orderdate <= TIMESTAMP '{ASOF}' GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1""",
)
def serve_external_scope(spark, sf_dir):
    """Outside facts summed again for each scope: keys, those with open facts, current ones and the key with most."""
    facts = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= _asof()).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max("o_orderdate").alias("last"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("scope"))
    keys = read(spark, sf_dir, "customer").join(nation, "c_nationkey").join(facts, "c_custkey", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    return keys.groupBy("scope").agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("open") > 0).alias("n_with_open"),
        F.sum("open").alias("n_open"),
        F.count_if(F.col("last") > F.add_months(_asof(), -6)).alias("n_current"),
        F.max_by("c_custkey", F.struct("open", -F.col("c_custkey"))).alias("worst_key"),
    )


@query(
    "serve_forecast",
    f"""WITH {PANEL_SQL}, s AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY q) AS p FROM panel), l AS (SELECT k, max(q) AS q, arg_max(x, q) AS x, avg(x - p) AS own, max(x - p) AS best, max("at") AS "at" FROM s GROUP BY k), a AS (SELECT avg(own) AS pace FROM l)
    SELECT k, CAST(q + step AS INTEGER) AS quarter, round(x + own * step, 6) AS mid, round(least(x + own * step, x + best * step, x + pace * step), 6) AS lo, round(greatest(x + own * step, x + best * step, x + pace * step), 6) AS hi, CAST(date_trunc('day', "at") + to_months(CAST(3 * step AS INTEGER)) AS DATE) AS due
    FROM l CROSS JOIN a CROSS JOIN range(1, 5) t(step) WHERE own IS NOT NULL""",
)
def serve_forecast(spark, sf_dir):
    """A band for each of the next four quarters of a key: its own pace, its best and that of all keys; keys seen once have none."""
    rows = panel(spark, sf_dir).select("k", "q", "x", "at", (F.col("x") - F.lag("x").over(Window.partitionBy("k").orderBy("q"))).alias("d"))
    last = rows.groupBy("k").agg(F.max("q").alias("q"), F.max_by("x", "q").alias("x"), F.avg("d").alias("own"), F.max("d").alias("best"), F.max("at").alias("at"))
    pace = F.broadcast(last.agg(F.avg("own").alias("pace")))  # one row
    steps = last.crossJoin(pace).where("own IS NOT NULL").select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"))
    to = lambda c: F.col("x") + F.col(c) * F.col("step")
    return steps.select(
        "k",
        (F.col("q") + F.col("step")).alias("quarter"),
        F.round(to("own"), 6).alias("mid"),
        F.round(F.least(to("own"), to("best"), to("pace")), 6).alias("lo"),
        F.round(F.greatest(to("own"), to("best"), to("pace")), 6).alias("hi"),
        F.add_months(F.to_date("at"), 3 * F.col("step")).alias("due"),
    )


@query(
    "serve_research_keys",
    """WITH now AS (SELECT max(ts) - INTERVAL 10 DAY AS since FROM events), f AS (SELECT *, event_type IN ('error', 'signup') AND ts > since AS live FROM events CROSS JOIN now)
    SELECT c_custkey, coalesce(n_facts, 0) AS n_facts, coalesce(n_live, 0) AS n_live, latest FROM customer LEFT JOIN (SELECT user_id, count(*) AS n_facts, count(*) FILTER (WHERE live) AS n_live, arg_max(event_type, row(ts, event_id)) AS latest FROM f GROUP BY 1) ON user_id = c_custkey""",
)
def serve_research_keys(spark, sf_dir):
    """Facts of each key, those that are live and negative, and the latest status; keys without facts stay."""
    events = read(spark, sf_dir, "events")
    since = F.broadcast(events.agg((F.max("ts") - F.expr("interval 10 days")).alias("since")))  # one row
    live = F.col("event_type").isin("error", "signup") & (F.col("ts") > F.col("since"))
    by = events.crossJoin(since).groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_facts"), F.count_if(live).alias("n_live"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return read(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left").select("c_custkey", n("n_facts"), n("n_live"), "latest")


@query(
    "ml_series_features",
    f"""WITH {PANEL_SQL}, s AS (SELECT *, lag(x) OVER w AS p1, lag(x, 2) OVER w AS p2, min(x) OVER w AS least, max(x) OVER w AS most, first_value(x) OVER w AS x0, row_number() OVER w AS step, lead(x) OVER w AS next FROM panel WINDOW w AS (PARTITION BY k ORDER BY q))
    SELECT k, q, step, x - p1 AS change, (x - p1) - (p1 - p2) AS change_of_change, x / nullif(x0, 0) AS growth, (x - least) / nullif(most - least, 0) AS position, next IS NOT NULL AS has_label, CASE WHEN next IS NOT NULL THEN next > x END AS label, coalesce(x > p1, false) AS persistence FROM s""",
)
def ml_series_features(spark, sf_dir):
    """The older feature set: changes, growth and position of a series as of each row, its label, and the persistence baseline."""
    w = Window.partitionBy("k").orderBy("q")
    x, p1, p2, least, most = F.col("x"), F.lag("x").over(w), F.lag("x", 2).over(w), F.min("x").over(w), F.max("x").over(w)
    after = F.lead("x").over(w)
    return panel(spark, sf_dir).select(
        "k",
        "q",
        F.row_number().over(w).alias("step"),
        (x - p1).alias("change"),
        ((x - p1) - (p1 - p2)).alias("change_of_change"),
        ratio(x, F.first("x").over(w)).alias("growth"),
        ratio(x - least, most - least).alias("position"),
        after.isNotNull().alias("has_label"),
        F.when(after.isNotNull(), after > x).alias("label"),
        F.coalesce(x > p1, F.lit(False)).alias("persistence"),
    )


@query(
    "serve_key_rows",
    """WITH a AS (SELECT 'P' || l_partkey AS alias, l_suppkey AS k, l_shipdate AS "at", l_orderkey * 10 + l_linenumber AS tie FROM lineitem UNION ALL SELECT 'P' || p_partkey, -1, NULL, p_partkey FROM part)
    SELECT alias, arg_max(k, row(coalesce("at", TIMESTAMP '1900-01-01'), tie, k)) AS k, count(DISTINCT k) AS n_keys FROM a GROUP BY 1""",
)
def serve_key_rows(spark, sf_dir):
    """Alias to key: of several keys the last wins, a key of its own only where there is no other."""
    used = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    own = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.lit(-1).cast("long").alias("k"), F.lit("1900-01-01").cast("timestamp").alias("at"), F.col("p_partkey").alias("tie"))
    alias = F.concat(F.lit("P"), F.col("p").cast("string"))
    return used.unionByName(own).groupBy(alias.alias("alias")).agg(F.max_by("k", F.struct("at", "tie", "k")).alias("k"), F.count_distinct("k").alias("n_keys"))


@query(
    "serve_document_rows",
    """WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS n_docs, arg_min(lang, row(-n, lang)) AS modal_lang, count(DISTINCT lang) AS n_langs FROM n GROUP BY 1""",
)
def serve_document_rows(spark, sf_dir):
    """One row a source: documents and the commonest language, the first by name where several are."""
    n = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    known = F.when(F.col("lang").isNotNull(), F.struct(-F.col("n"), "lang"))
    return n.groupBy("source").agg(F.sum("n").alias("n_docs"), F.min_by("lang", known).alias("modal_lang"), F.count_distinct("lang").alias("n_langs"))
