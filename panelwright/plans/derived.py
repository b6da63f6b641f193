"""Composites: cohorts, roll-ups, priors, contexts, bands and page reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.dates import quarter_index
from panelwright.operators import aggregates, scores
from panelwright.plans.panel import PANEL_SQL, panel
from panelwright.plans.registry import query
from panelwright.sources.tables import read

ASOF = "1997-06-30"


def _asof():
    return F.lit(ASOF).cast("timestamp")


@query(
    "ml_cohorts",
    f"""WITH {PANEL_SQL}, s AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY q) AS p FROM panel)
    SELECT k, q, datediff('day', "at", TIMESTAMP '{ASOF}') > 180 AS not_yet_due, coalesce(sum(CAST(x > p AS INTEGER)) OVER (PARTITION BY k ORDER BY q), 0) = 0 AS pre_event FROM s""",
)
def ml_cohorts(spark, sf_dir):
    """Rows whose outcome is not due yet, and rows before any rise on record."""
    w = Window.partitionBy("k").orderBy("q")
    rows = panel(spark, sf_dir).withColumn("rose", (F.col("x") > F.lag("x").over(w)).cast("int"))
    so_far = F.coalesce(F.sum("rose").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.select("k", "q", (F.datediff(_asof(), "at") > 180).alias("not_yet_due"), (so_far == 0).alias("pre_event"))


@query(
    "ml_unscorable",
    """WITH t AS (SELECT o_orderkey AS i, o_totalprice AS a, CASE WHEN o_orderkey % 9 > 0 OR o_orderstatus = 'F' THEN o_custkey END AS b, CASE WHEN o_orderkey % 5 > 0 THEN 1 END AS c, o_orderstatus AS s FROM orders)
    SELECT i, b IS NULL AS unscorable FROM t WHERE s <> 'F'""",
)
def ml_unscorable(spark, sf_dir):
    i, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = read(spark, sf_dir, "orders").select(i.alias("i"), F.col("o_totalprice").alias("a"), F.when((i % 9 > 0) | (s == "F"), F.col("o_custkey")).alias("b"), F.when(i % 5 > 0, 1).alias("c"), s.alias("s"))
    new = rows.where("s <> 'F'")
    return new.select("i", scores.unscorable(new, rows.where("s = 'F'"), ["a", "b", "c"]).alias("unscorable"))


@query(
    "join_words_contained",
    "SELECT p_partkey, b FROM part, (SELECT DISTINCT split_part(p_name, ' ', 1) AS b FROM part) WHERE list_contains(string_split(lower(p_name), ' '), b) AND length(b) > 3",
)
def join_words_contained(spark, sf_dir):
    """Names found as whole words of a text: words and names meet by equality, not in pairs."""
    parts = read(spark, sf_dir, "part")
    names = parts.select(F.split("p_name", " ")[0].alias("b")).where("length(b) > 3").distinct()
    found = parts.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("b"))
    return found.join(names, "b", "left_semi").select("p_partkey", "b")


@query(
    "join_near_reports",
    """WITH r AS (SELECT DISTINCT user_id AS u, event_type AS t, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('click', 'error')),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY u ORDER BY d) AS n FROM r)
    SELECT a.u, a.d AS d, b.d AS other FROM n a JOIN n b ON a.u = b.u AND a.t = 'click' AND b.t = 'error' AND abs(a.n - b.n) <= 1""",
)
def join_near_reports(spark, sf_dir):
    """Pairs of kinds inside a group at most one report apart: each row meets three report numbers."""
    rows = read(spark, sf_dir, "events").where("event_type IN ('click', 'error')").select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.to_date("ts").alias("d")).distinct()
    numbered = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("u").orderBy("d")))
    a = numbered.where("t = 'click'").select("u", "d", F.explode(F.sequence(F.col("n") - 1, F.col("n") + 1)).alias("n"))
    b = numbered.where("t = 'error'").select("u", F.col("d").alias("other"), "n")
    return a.join(b, ["u", "n"]).select("u", "d", "other")


@query("agg_deduped", "SELECT l_suppkey, count(*) AS n_parts, round(sum(price), 2) AS price FROM (SELECT l_suppkey, l_partkey, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agg_deduped(spark, sf_dir):
    """Sums over one row for each (group, id), the one of the least price."""
    once = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("price"))
    return once.groupBy("l_suppkey").agg(F.count("*").alias("n_parts"), F.round(F.sum("price"), 2).alias("price"))


@query("agg_max_by_rank", "SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) AS stage FROM orders GROUP BY 1")
def agg_max_by_rank(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", rank).alias("stage"))


_MEMBERS = """m AS (SELECT DISTINCT c_mktsegment AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'unspecified' ELSE o_orderpriority END AS authority, c_nationkey AS state, c_custkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "agg_clusters_coarser",
    f"""WITH {_MEMBERS}, fine AS (SELECT category, authority, state, count(*) AS n FROM m GROUP BY 1, 2, 3),
    coarse AS (SELECT category, state, count(DISTINCT k) AS n, count(DISTINCT CASE WHEN authority = 'unspecified' THEN k END) AS u FROM m GROUP BY 1, 2)
    SELECT 'authority' AS level, category, authority, state, n FROM fine WHERE n >= 2
    UNION ALL SELECT 'state', category, NULL, state, n FROM coarse WHERE n >= 2 AND u * 2 >= n AND u < n""",
)
def agg_clusters_coarser(spark, sf_dir):
    """Clusters of at least 2 members, and where most are unspecified the coarser group, unless it is the same set."""
    customers = read(spark, sf_dir, "customer")
    authority = F.when(F.col("o_orderkey") % 3 == 0, "unspecified").otherwise(F.col("o_orderpriority"))
    m = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("category"), authority.alias("authority"), F.col("c_nationkey").alias("state"), F.col("c_custkey").alias("k")).distinct()
    fine = m.groupBy("category", "authority", "state").agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("authority").alias("level"), "category", "authority", "state", "n")
    by_key = m.groupBy("category", "state", "k").agg(F.bool_or(F.col("authority") == "unspecified").alias("u"))
    coarse = by_key.groupBy("category", "state").agg(F.count("*").alias("n"), F.count_if("u").alias("u")).where("n >= 2 AND u * 2 >= n AND u < n")
    return fine.unionByName(coarse.select(F.lit("state").alias("level"), "category", F.lit(None).cast("string").alias("authority"), "state", "n"))


@query(
    "agg_weighted_precision",
    """WITH t AS (SELECT l_discount AS s, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity AS w FROM lineitem),
    g AS (SELECT s, sum(w * y) AS p, sum(w) AS n FROM t GROUP BY s), c AS (SELECT p, sum(p) OVER o AS cp, sum(n) OVER o AS cn FROM g WINDOW o AS (ORDER BY s DESC))
    SELECT round(sum(p * cp / cn) / sum(p), 9) AS ap FROM c""",
)
def agg_weighted_precision(spark, sf_dir):
    """Weighted average precision; rows of equal score count together."""
    ap = aggregates.weighted_precision(read(spark, sf_dir, "lineitem"), "l_discount", F.col("l_returnflag") == "R", F.col("l_quantity"))
    return ap.select(F.round("ap", 9).alias("ap"))


_FOLDS = "f AS (SELECT year(l_shipdate) AS fold, l_linestatus AS model, avg(pow(l_discount * 10 - CAST(l_returnflag = 'R' AS INTEGER), 2)) AS brier FROM lineitem GROUP BY 1, 2)"


@query("agg_fold_mean", f"WITH {_FOLDS} SELECT model, count(*) AS folds, round(avg(brier), 9) AS mean, round(stddev_samp(brier), 9) AS sd FROM f GROUP BY model")
def agg_fold_mean(spark, sf_dir):
    error = F.pow(F.col("l_discount") * 10 - (F.col("l_returnflag") == "R").cast("int"), 2)
    folds = read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("fold"), F.col("l_linestatus").alias("model")).agg(F.avg(error).alias("brier"))
    return folds.groupBy("model").agg(F.count("*").alias("folds"), F.round(F.avg("brier"), 9).alias("mean"), F.round(F.stddev_samp("brier"), 9).alias("sd"))


@query(
    "ml_deltas",
    f"WITH {_FOLDS} SELECT a.fold, round(a.brier - b.brier, 9) AS delta, a.brier < b.brier AS better FROM f a JOIN f b ON a.fold = b.fold AND a.model = 'F' AND b.model = 'O'",
)
def ml_deltas(spark, sf_dir):
    """One variant's metric less the other's, fold by fold."""
    error = F.pow(F.col("l_discount") * 10 - (F.col("l_returnflag") == "R").cast("int"), 2)
    folds = read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("fold")).agg(*[F.avg(F.when(F.col("l_linestatus") == m, error)).alias(m) for m in ("F", "O")])
    both = folds.where("F IS NOT NULL AND O IS NOT NULL")
    return both.select(F.col("fold").cast("long").alias("fold"), F.round(F.col("F") - F.col("O"), 9).alias("delta"), (F.col("F") < F.col("O")).alias("better"))


@query(
    "serve_scope_recount",
    f"WITH {_MEMBERS} SELECT category, state, count(DISTINCT k) AS n_all, count(DISTINCT CASE WHEN k % 2 = 0 THEN k END) AS n_scope FROM m GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN k % 2 = 0 THEN k END) > 0",
)
def serve_scope_recount(spark, sf_dir):
    """Clusters counted again over the members in scope; empty ones go."""
    m = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = m.select(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("state"), F.col("c_custkey").alias("k")).distinct()
    return keys.groupBy("category", "state").agg(F.count("*").alias("n_all"), F.count_if(F.col("k") % 2 == 0).alias("n_scope")).where("n_scope > 0")


@query("win_suffixes", "SELECT p_partkey, concat(p_name, CASE WHEN n > 0 THEN concat('#', n) ELSE '' END) AS id FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name, p_partkey // 50 ORDER BY p_partkey) - 1 AS n FROM part)")
def win_suffixes(spark, sf_dir):
    """Ids of repeated names get their count so far as a suffix."""
    n = F.row_number().over(Window.partitionBy("p_name", F.floor(F.col("p_partkey") / 50)).orderBy("p_partkey")) - 1
    rows = read(spark, sf_dir, "part").withColumn("n", n)
    return rows.select("p_partkey", F.concat("p_name", F.when(F.col("n") > 0, F.concat(F.lit("#"), "n")).otherwise("")).alias("id"))


@query("serve_fit_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 1500")
def serve_fit_budget(spark, sf_dir):
    """The latest turns of a conversation that fit a budget of characters."""
    used = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return read(spark, sf_dir, "conversations").withColumn("used", used).where("used <= 1500").select("conv_id", "turn")


@query("text_free", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'the work is ' || c_mktsegment END AS free FROM customer")
def text_free(spark, sf_dir):
    """Remarks without their template part; null where fewer than three words are left."""
    raw = F.concat(F.lit("Status as on 01/2020: "), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("the work is "), F.col("c_mktsegment"))).otherwise("nil report"))
    free = F.trim(F.regexp_replace(raw, r"^Status as on \d{2}/\d{4}:\s*", ""))
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(F.regexp_count(free, F.lit(r"\S+")) >= 3, free).alias("free"))


@query(
    "text_area_band",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN p_size::DOUBLE ELSE 0 END AS lo, CASE p_partkey % 4 WHEN 0 THEN 'infinity'::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size + 10.0 ELSE 'infinity'::DOUBLE END AS hi FROM part",
)
def text_area_band(spark, sf_dir):
    """An area condition in words as an interval."""
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    cond = F.when(k == 0, F.concat(F.lit("> "), n, F.lit(" ha"))).when(k == 1, F.concat(F.lit("up to "), n, F.lit(" ha"))).when(k == 2, F.concat(n, F.lit(" to "), n + 10, F.lit(" ha"))).otherwise("any")
    part = lambda pattern, i=1: F.regexp_extract(cond, pattern, i).try_cast("double")
    span = r"([\d.]+)\s*(?:to|-)\s*([\d.]+)"
    lo = F.coalesce(part(span), part(r"(?:>|above|more than)\s*([\d.]+)"), F.lit(0.0))
    hi = F.coalesce(part(span, 2), part(r"(?:<=?|up to|below)\s*([\d.]+)"), F.lit(float("inf")))
    return read(spark, sf_dir, "part").select("p_partkey", lo.alias("lo"), hi.alias("hi"))


@query("text_private_names", "SELECT c_custkey, c_custkey % 4 < 2 AS private FROM customer")
def text_private_names(spark, sf_dir):
    """Whether an honorific stands before a capitalised name."""
    who = F.when(F.col("c_custkey") % 4 == 0, "Shri Ram Lal said").when(F.col("c_custkey") % 4 == 1, "met Dr. Anna Berg").when(F.col("c_custkey") % 4 == 2, "the ministry said").otherwise("dr of works")
    return read(spark, sf_dir, "customer").select("c_custkey", who.rlike(r"\b(?:Shri|Smt|Mr|Mrs|Ms|Dr|Prof)\.?\s+\p{Lu}\p{Ll}+").alias("private"))


@query(
    "text_clipped_labels",
    """WITH l AS (SELECT DISTINCT p_name AS full_name FROM part), c AS (SELECT p_partkey, left(p_name, CAST(6 + p_partkey % 4 AS INTEGER)) AS clip FROM part),
    j AS (SELECT p_partkey, min(full_name) AS f, count(*) AS n FROM c JOIN l ON starts_with(full_name, clip) GROUP BY 1) SELECT p_partkey, CASE WHEN n = 1 THEN f END AS label FROM j""",
)
def text_clipped_labels(spark, sf_dir):
    """Clipped labels completed where just one label begins so: labels are cut at every length and met by equality."""
    parts = read(spark, sf_dir, "part")
    labels = parts.select(F.col("p_name").alias("label")).distinct()
    begun = labels.select("label", F.explode(F.transform(F.sequence(F.lit(6), F.lit(9)), lambda n: F.substring("label", 1, n))).alias("clip")).distinct()
    whole = begun.groupBy("clip").agg(F.min("label").alias("f"), F.count_distinct("label").alias("n"))
    clipped = parts.select("p_partkey", F.substring("p_name", F.lit(1), (6 + F.col("p_partkey") % 4).cast("int")).alias("clip"))
    return clipped.join(whole, "clip").select("p_partkey", F.when(F.col("n") == 1, F.col("f")).alias("label"))


_P = "(o_orderkey % 101) / 100.0"


@query(
    "proj_band_words",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN {_P} >= 0.75 THEN 'very likely' WHEN {_P} >= 0.5 THEN 'likely' WHEN {_P} >= 0.25 THEN 'possible' ELSE 'unlikely' END AS chance,
    CASE WHEN o_custkey % 40 < 6 THEN 'under 6 months' WHEN o_custkey % 40 < 12 THEN '6 to 12 months' WHEN o_custkey % 40 <= 24 THEN '1 to 2 years' ELSE 'over 2 years' END AS slip FROM orders""",
)
def proj_band_words(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 13 > 0, (F.col("o_orderkey") % 101) / 100.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", scores.chance_word(p).alias("chance"), scores.slip_word(F.col("o_custkey") % 40).alias("slip"))


@query("text_proposal_numbers", "SELECT c_custkey, concat('FP/AB/RD/', c_custkey, '/2019;FP/CD/RD/', c_custkey + 1, '/2020') AS numbers FROM customer")
def text_proposal_numbers(spark, sf_dir):
    """Proposal numbers named in a text, once each in order of appearance, spelt alike."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("see fp / AB/RD/"), k, F.lit("/2019 and FP/CD/RD/"), k + 1, F.lit("/2020, FP/AB/RD/"), k, F.lit("/2019"))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)FP\s*/\s*\w+/\w+/\d+/\d{4}"), F.lit(0)), lambda x: F.upper(F.regexp_replace(x, r"\s", "")))
    return read(spark, sf_dir, "customer").select(k, F.array_join(F.array_distinct(found), ";").alias("numbers"))


@query(
    "text_state_labels",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Orissa' WHEN 1 THEN 'multi-state' WHEN 2 THEN 'Odisha' ELSE 'unknown' END AS was, CASE c_custkey % 4 WHEN 0 THEN 'Odisha' WHEN 1 THEN 'Multi-State' WHEN 2 THEN 'Odisha' END AS state FROM customer""",
)
def text_state_labels(spark, sf_dir):
    """State labels by alias; several joined states are one label, unknown ones none."""
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "Orissa").when(k == 1, "multi-state").when(k == 2, "Odisha").otherwise("unknown")
    printed = F.when(k == 1, "Bihar, Orissa").otherwise(raw)
    alias = F.create_map(*map(F.lit, ("orissa", "Odisha", "odisha", "Odisha", "bihar", "Bihar")))
    names = F.array_distinct(F.transform(F.split(printed, r"\s*[,/&]\s*"), lambda x: F.try_element_at(alias, F.lower(F.trim(x)))))
    state = F.when(F.exists(names, lambda x: x.isNull()), F.lit(None)).when(F.size(names) > 1, "Multi-State").otherwise(names[0])
    return read(spark, sf_dir, "customer").select("c_custkey", raw.alias("was"), state.alias("state"))


@query("proj_curve_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(round(o_orderkey % 50 / 4.0) AS INTEGER)) AS DATE) AS at FROM orders")
def proj_curve_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), F.round(F.col("o_orderkey") % 50 / 4.0).cast("int")).alias("at"))


@query(
    "proj_rule_score",
    """WITH t AS (SELECT *, CASE WHEN l_linenumber % 3 > 0 THEN l_discount * 2000 END AS o, l_quantity * 2 AS d, CASE WHEN l_linenumber % 2 > 0 THEN l_quantity * 2 END AS p, l_tax * 20 AS s FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(0.3 * least(greatest(coalesce(o, 0) / 81.4 * 100, 0), 100) + 0.3 * least(greatest(d / 75.0 * 100, 0), 100) + 0.25 * least(greatest(100 - coalesce(p, 0), 0), 100) + 0.15 * least(greatest(s / 1.5 * 100, 0), 100), 6) AS score,
    CAST((l_linenumber > 1)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT + (l_tax >= 0.04)::INT + (l_discount >= 0.05)::INT AS INTEGER) AS points,
    round(CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 ELSE (l_discount * 10 + l_tax * 10) / 2 END, 9) AS composite, CASE WHEN l_linenumber % 2 = 0 THEN 'first_only' ELSE 'both' END AS coverage FROM t""",
)
def proj_rule_score(spark, sf_dir):
    """Rule score, complexity points and the two-part composite with its coverage."""
    n, quantity, discount, tax = (F.col(c) for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax"))
    score = scores.rule_score(F.when(n % 3 > 0, discount * 2000), quantity * 2, F.when(n % 2 > 0, quantity * 2), tax * 20)
    both, coverage = scores.composite(discount * 10, F.when(n % 2 > 0, tax * 10))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(score, 6).alias("score"),
        scores.complexity([n > 1, quantity >= 20, quantity >= 40, tax >= 0.04, discount >= 0.05]).alias("points"), F.round(both, 9).alias("composite"), coverage.alias("coverage"),
    )


@query(
    "proj_rounded",
    "SELECT o_orderkey, CAST(sign(v) * floor(abs(v) + 0.5) AS DOUBLE) AS half, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN 100 ELSE 1 END, 4) AS scaled FROM (SELECT *, (o_orderkey % 21 - 10) / 2.0 AS v FROM orders)",
)
def proj_rounded(spark, sf_dir):
    """Halves away from zero, and values scaled by their unit's factor."""
    factors = spark.createDataFrame([("F", 0.1), ("O", 100.0), ("P", 1.0)], "o_orderstatus string, factor double")
    rows = read(spark, sf_dir, "orders").join(F.broadcast(factors), "o_orderstatus", "left")
    half = scores.half_away((F.col("o_orderkey") % 21 - 10) / 2.0)
    return rows.select("o_orderkey", half.alias("half"), F.round(F.col("o_totalprice") * F.coalesce("factor", F.lit(1.0)), 4).alias("scaled"))


@query(
    "proj_strengths",
    """WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 5 THEN l_quantity END AS s FROM lineitem),
    r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY s DESC NULLS LAST) - 1 AS p, count(s) OVER (PARTITION BY l_orderkey) AS n FROM t)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN s IS NOT NULL THEN ['strong', 'moderate', 'slight'][CAST(3 * p // n + 1 AS INTEGER)] END AS strength FROM r""",
)
def proj_strengths(spark, sf_dir):
    rows = scores.thirds(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.when(F.col("l_quantity") > 5, F.col("l_quantity")))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "strength")


@query("text_json_within", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def text_json_within(spark, sf_dir):
    """The JSON object inside a chatty answer: from the first brace to the last."""
    said = F.concat(F.lit("Sure, here:\n```json\n"), "props", F.lit("\n``` done."))
    found = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


@query(
    "label_checks",
    f"WITH {PANEL_SQL}, l AS (SELECT a.k, a.q, b.q AS t FROM panel a JOIN panel b ON a.k = b.k AND b.q = a.q + 4) SELECT 4 AS horizon, count(*) AS n_rows, count(*) FILTER (WHERE t - q <> 4) AS wrong_horizon, count(*) - count(DISTINCT row(k, q)) AS repeated FROM l",
)
def label_checks(spark, sf_dir):
    from panelwright.plans.panel import labels

    rows = labels(panel(spark, sf_dir), 4)
    by_key = rows.groupBy("k", "q").agg(F.count("*").alias("n"), F.count_if(F.col("target_q") - F.col("q") != 4).alias("bad"))
    return by_key.agg(F.lit(4).alias("horizon"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong_horizon"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


@query(
    "dq_printed_share",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(100 * l_discount / (l_discount + l_tax), 6) AS computed, CAST(floor(l_quantity) AS INTEGER) AS printed,
    abs(round(100 * l_discount / (l_discount + l_tax), 6) - floor(l_quantity)) > 1 AS mismatch FROM lineitem WHERE l_discount + l_tax > 0""",
)
def dq_printed_share(spark, sf_dir):
    """Printed against computed percentages."""
    share = F.round(100 * F.col("l_discount") / (F.col("l_discount") + F.col("l_tax")), 6)
    printed = F.floor("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").where("l_discount + l_tax > 0").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", share.alias("computed"), printed.alias("printed"), (F.abs(share - printed) > 1).alias("mismatch"))


@query(
    "dq_report_flags",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'partial;scanned' WHEN 1 THEN 'reprint' ELSE '' END AS flags, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderkey % 3 = 1 THEN 'reprint' ELSE 'interim' END AS tier FROM orders",
)
def dq_report_flags(spark, sf_dir):
    """Flags read from a note, and the tier of the source."""
    k = F.col("o_orderkey") % 3
    note = F.when(k == 0, "Scanned copy, pages missing").when(k == 1, "reprint of May").otherwise("clean")
    rules = [("partial", r"(?i)missing|incomplete"), ("scanned", r"(?i)scan"), ("reprint", r"(?i)reprint")]
    flags = F.array_compact(F.array(*[F.when(note.rlike(p), F.lit(n)) for n, p in rules]))
    tier = F.when(F.col("o_orderstatus") == "F", "final").when(F.array_contains(flags, "reprint"), "reprint").otherwise("interim")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(flags, ";").alias("flags"), tier.alias("tier"))


_MONTHS = "m AS (SELECT c_nationkey AS sector, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 4 > 0) AS actual, arg_max(c_acctbal, o_orderkey) AS target, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(
    "panel_sector_context",
    f"""WITH {_MONTHS}, q AS (SELECT sector, CAST(year(month) * 4 + quarter(month) - 1 AS INTEGER) AS q, sum(CASE WHEN actual IS NOT NULL AND target IS NOT NULL THEN actual END) AS a,
      sum(CASE WHEN actual IS NOT NULL AND target IS NOT NULL THEN target END) AS t, avg(target) AS growth, count(*) AS n_months FROM m GROUP BY 1, 2)
    SELECT sector, q, round(a / nullif(t, 0), 6) AS ratio, round(growth, 6) AS growth, n_months, round(avg(growth) OVER (PARTITION BY sector ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS trend_4q FROM q""",
)
def panel_sector_context(spark, sf_dir):
    """Headline of each sector and quarter: ratio over months that have both values, growth, and its four-quarter trend."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.trunc("o_orderdate", "month").alias("month")
    k = F.col("o_orderkey")
    months = orders.groupBy(F.col("c_nationkey").alias("sector"), month).agg(F.max_by("o_totalprice", F.when(k % 4 > 0, k)).alias("_a"), F.max(F.when(k % 4 > 0, k)).alias("_k"), F.max_by("c_acctbal", k).alias("target"))
    months = months.withColumn("actual", F.when(F.col("_k").isNotNull(), F.col("_a")))
    both = F.col("actual").isNotNull() & F.col("target").isNotNull()
    q = quarter_index(F.col("month")).alias("q")
    by_quarter = months.groupBy("sector", q).agg(F.sum(F.when(both, F.col("actual"))).alias("a"), F.sum(F.when(both, F.col("target"))).alias("t"), F.avg("target").alias("g"), F.count("*").alias("n_months"))
    trend = F.avg("g").over(Window.partitionBy("sector").orderBy("q").rangeBetween(-3, 0))
    return by_quarter.select("sector", "q", F.round(F.try_divide("a", "t"), 6).alias("ratio"), F.round("g", 6).alias("growth"), "n_months", F.round(trend, 6).alias("trend_4q"))


_MENTIONS = "e AS (SELECT user_id AS k, CAST(date_trunc('day', ts) AS DATE) AS d, bool_or(event_type = 'error') AS hit, arg_max(event_type, row(ts, event_id)) = 'purchase' AS done FROM events GROUP BY 1, 2)"


@query(
    "panel_open_flags",
    f"""WITH {_MENTIONS}, n AS (SELECT *, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY k ORDER BY d)),
    l AS (SELECT *, max(CASE WHEN hit THEN n END) OVER w AS last_n, max(CASE WHEN hit THEN d END) OVER w AS last_d, arg_max(done, CASE WHEN hit THEN n END) OVER w AS last_done FROM n WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT k, d, coalesce(last_n >= n - 3 AND NOT last_done, false) AS by_rule, coalesce(last_n >= n - 3 AND NOT last_done AND datediff('day', last_d, d) < 5, false) AS live FROM l""",
)
def panel_open_flags(spark, sf_dir):
    """Whether a category is open at each date: mentioned in one of the key's last four reports, not reported done, and by
    calendar not yet expired."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "event_type", "ts", "event_id")
    reports = events.groupBy("k", "d").agg(F.bool_or(F.col("event_type") == "error").alias("hit"), (F.max_by("event_type", F.struct("ts", "event_id")) == "purchase").alias("done"))
    w = Window.partitionBy("k").orderBy("d")
    rows = reports.withColumn("n", F.row_number().over(w))
    last = F.max(F.when(F.col("hit"), F.struct("n", "d", "done"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("last", last)
    rule = F.coalesce((F.col("last.n") >= F.col("n") - 3) & ~F.col("last.done"), F.lit(False))
    return rows.select("k", "d", rule.alias("by_rule"), (rule & (F.datediff("d", "last.d") < 5)).alias("live"))


@query(
    "serve_open_counts",
    "WITH l AS (SELECT user_id, max(ts) AS last, arg_max(event_type, row(ts, event_id)) AS t FROM events GROUP BY 1) SELECT t AS category, count(*) AS n_open, count(*) FILTER (WHERE last > (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS n_live FROM l GROUP BY 1",
)
def serve_open_counts(spark, sf_dir):
    """Keys open by rule against those still live, by category."""
    events = read(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("category"))
    upto = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    return last.join(F.broadcast(upto)).groupBy("category").agg(F.count("*").alias("n_open"), F.count_if(F.col("last") > F.col("since")).alias("n_live"))


@query(
    "panel_latest_known",
    "SELECT o_custkey AS k, arg_max(p, q) AS price, max(q) FILTER (WHERE p IS NOT NULL) AS price_as_of, arg_max(s, q) AS priority, max(q) FILTER (WHERE s IS NOT NULL) AS priority_as_of FROM (SELECT o_custkey, row(o_orderdate, o_orderkey) AS r, o_orderkey AS q0, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS p, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS s, CAST(epoch(o_orderdate) AS BIGINT) * 10000000 + o_orderkey AS q FROM orders) GROUP BY 1",
)
def panel_latest_known(spark, sf_dir):
    """Each fact's latest known value and when it was known."""
    i = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(i % 3 > 0, F.col("o_totalprice")).alias("p"), F.when(i % 4 > 0, F.col("o_orderpriority")).alias("s"), (F.unix_timestamp("o_orderdate") * 10000000 + i).alias("q"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("q"))
    return rows.groupBy("k").agg(F.max_by("p", known("p")).alias("price"), F.max(known("p")).alias("price_as_of"), F.max_by("s", known("s")).alias("priority"), F.max(known("s")).alias("priority_as_of"))


@query(
    "agg_priors",
    """WITH t AS (SELECT o_totalprice AS y, o_orderstatus = 'F' AS g, o_orderpriority AS a, year(o_orderdate) AS b FROM orders),
    s AS (SELECT a, b, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n0, sum(y) FILTER (WHERE g) AS s1, sum(y) FILTER (WHERE NOT g) AS s0 FROM t GROUP BY 1, 2),
    u AS (SELECT *, n1 > 0 AND n0 > 0 AS used FROM s), w AS (SELECT CAST(sum(n1) AS BIGINT) AS n FROM u WHERE used)
    SELECT count(*) FILTER (WHERE used) AS strata, round(sum(CASE WHEN used THEN s1 END) / (SELECT n FROM w), 4) AS mean_in, round(sum(CASE WHEN used THEN n1 * s0 / n0 END) / (SELECT n FROM w), 4) AS mean_out,
      round((sum(CASE WHEN used THEN s1 END) - sum(CASE WHEN used THEN n1 * s0 / n0 END)) / (SELECT n FROM w), 4) AS extra, round((SELECT n FROM w) / sum(n1), 6) AS matched FROM u""",
)
def agg_priors(spark, sf_dir):
    """A measured prior: the difference of a group to its baseline over matching strata."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").alias("g"), F.col("o_orderpriority").alias("a"), F.year("o_orderdate").alias("b"))
    found = scores.stratified_difference(rows, "y", ["a", "b"], "g")
    return found.select("strata", *[F.round(c, 6 if c == "matched" else 4).alias(c) for c in ("mean_in", "mean_out", "extra", "matched")])


@query(
    "serve_applicable",
    f"""SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 AND c_custkey % 5 > 0 THEN 'stage' END, CASE WHEN c_acctbal > 0 AND c_acctbal <= 3000 THEN 'share_low' WHEN c_acctbal > 3000 THEN 'share_high' END, CASE WHEN c_nationkey >= 20 THEN 'complex' END) AS priors,
    coalesce(last > TIMESTAMP '{ASOF}' - INTERVAL 12 MONTH, false) AS current FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate <= TIMESTAMP '{ASOF}' GROUP BY 1) ON o_custkey = c_custkey""",
)
def serve_applicable(spark, sf_dir):
    """The priors that apply to each key at a date, and whether what they rest on is current."""
    last = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= _asof()).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    b = F.col("c_acctbal")
    found = F.concat_ws(";", F.when((b < 0) & (F.col("c_custkey") % 5 > 0), "stage"), F.when((b > 0) & (b <= 3000), "share_low").when(b > 3000, "share_high"), F.when(F.col("c_nationkey") >= 20, "complex"))
    current = F.coalesce(F.col("last") > F.add_months(_asof(), -12), F.lit(False))
    return read(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", found.alias("priors"), current.alias("current"))


@query(
    "er_entities",
    """WITH r AS (SELECT coalesce(CASE WHEN o_orderkey % 3 > 0 THEN concat('K', o_custkey) END, concat('C', o_orderkey % 50)) AS e, * FROM orders),
    c AS (SELECT e, o_orderpriority AS p, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT e AS entity, min(o_orderdate) AS first_seen, (SELECT arg_min(p, row(-n, p)) FROM c WHERE c.e = r.e) AS name, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS first_cost, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS status FROM r GROUP BY e""",
)
def er_entities(spark, sf_dir):
    """Rows rolled up to entities: the commonest name, the first cost and the latest status."""
    i = F.col("o_orderkey")
    entity = F.coalesce(F.when(i % 3 > 0, F.concat(F.lit("K"), "o_custkey")), F.concat(F.lit("C"), i % 50))
    rows, order = read(spark, sf_dir, "orders").withColumn("entity", entity), F.struct("o_orderdate", "o_orderkey")
    names = rows.groupBy("entity", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("name"))
    out = rows.groupBy("entity").agg(F.min("o_orderdate").alias("first_seen"), F.min_by("o_totalprice", order).alias("first_cost"), F.max_by("o_orderstatus", order).alias("status"))
    return out.join(names, "entity")


@query(
    "ml_blocks",
    f"WITH {PANEL_SQL}, c AS (SELECT q, avg(CASE WHEN open_x IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM panel GROUP BY q), r AS (SELECT q, q - row_number() OVER (ORDER BY q) AS g FROM c WHERE share >= 0.4) SELECT min(q) AS first, max(q) AS last FROM r GROUP BY g",
)
def ml_blocks(spark, sf_dir):
    """Blocks of consecutive quarters whose coverage is reliable."""
    share = panel(spark, sf_dir).groupBy("q").agg(F.avg(F.col("open_x").isNull().cast("double")).alias("share"))
    return scores.blocks(share.where("share >= 0.4"), "q")


@query(
    "ml_split",
    """WITH e AS (SELECT quantile_disc(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
    SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'train' WHEN year(o_orderdate) < 1998 THEN 'validation' ELSE 'test' END AS part, CAST(len(list_filter(e, lambda x: x < o_totalprice)) AS INTEGER) AS band FROM orders, e""",
)
def ml_split(spark, sf_dir):
    """Parts by period, and size bands whose edges come from the training part alone."""
    orders = read(spark, sf_dir, "orders")
    edges = orders.where("o_orderdate < '1997-01-01'").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY o_totalprice)").alias(f"e{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    part = F.when(F.year("o_orderdate") < 1997, "train").when(F.year("o_orderdate") < 1998, "validation").otherwise("test")
    band = sum(((F.col(f"e{i}") < F.col("o_totalprice")).cast("int") for i in range(3)), F.lit(0))
    return orders.join(F.broadcast(edges)).select("o_orderkey", part.alias("part"), band.alias("band"))


@query("ml_fold_lists", f"WITH {PANEL_SQL} SELECT DISTINCT q, concat_ws(',', q - 4, q - 5, q - 6, q - 7) AS folds FROM panel")
def ml_fold_lists(spark, sf_dir):
    """The folds that calibrate a cutoff at horizon 4: c - h and the three before."""
    return panel(spark, sf_dir).select("q").distinct().select("q", F.concat_ws(",", *[F.col("q") - 4 - i for i in range(4)]).alias("folds"))


@query(
    "serve_stagnant",
    f"""WITH {PANEL_SQL}, s AS (SELECT k, arg_max(n, q) AS n, max(q) - arg_min(q, q) AS spent, CASE WHEN k % 4 > 0 THEN arg_max(x, q) / 5000 END AS done FROM panel GROUP BY k)
    SELECT k, n >= 1 AND spent >= 4 AND NOT coalesce(done >= 90, false) AS stagnant FROM s""",
)
def serve_stagnant(spark, sf_dir):
    """The stagnation badge; unknown progress does not block it."""
    s = panel(spark, sf_dir).groupBy("k").agg(F.max_by("n", "q").alias("n"), (F.max("q") - F.min("q")).alias("spent"), F.max_by("x", "q").alias("x"))
    done = F.when(F.col("k") % 4 > 0, F.col("x") / 5000)
    return s.select("k", ((F.col("n") >= 1) & (F.col("spent") >= 4) & ~F.coalesce(done >= 90, F.lit(False))).alias("stagnant"))


@query(
    "serve_spans",
    f"WITH {PANEL_SQL}, v AS (SELECT *, x - lag(x) OVER (PARTITION BY k ORDER BY q) AS v1, first_value(x) OVER (PARTITION BY k ORDER BY q) AS x0, min(q) OVER (PARTITION BY k) AS q0 FROM panel) SELECT k, min(q) AS first_q, max(q) AS last_q, round(arg_max(coalesce(v1, (x - x0) / nullif(q - q0, 0), 0), q), 4) AS velocity FROM v GROUP BY k",
)
def serve_spans(spark, sf_dir):
    """Span and latest velocity, falling back to the mean over the span."""
    w = Window.partitionBy("k").orderBy("q")
    rows = panel(spark, sf_dir).withColumns({"v1": F.col("x") - F.lag("x").over(w), "x0": F.first("x").over(w), "q0": F.first("q").over(w)})
    v = F.coalesce("v1", F.try_divide(F.col("x") - F.col("x0"), F.col("q") - F.col("q0")), F.lit(0.0))
    return rows.groupBy("k").agg(F.min("q").alias("first_q"), F.max("q").alias("last_q"), F.round(F.max_by(v, "q"), 4).alias("velocity"))


@query(
    "serve_bundle",
    "SELECT 'customer' AS part, CAST(c_custkey AS BIGINT) AS k, CAST(to_json({'name': c_name}) AS VARCHAR) AS row FROM customer UNION ALL SELECT 'orders', o_custkey, CAST(to_json({'order': o_orderkey, 'status': o_orderstatus}) AS VARCHAR) FROM orders",
)
def serve_bundle(spark, sf_dir, key=None):
    """Every table's rows of one key, or of all; a table that is missing adds none."""
    from panelwright.sources.readers import optional

    parts = [
        read(spark, sf_dir, "customer").select(F.lit("customer").alias("part"), F.col("c_custkey").alias("k"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("row")),
        read(spark, sf_dir, "orders").select(F.lit("orders").alias("part"), F.col("o_custkey").alias("k"), F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"))).alias("row")),
        optional(spark, f"{sf_dir}/alerts.parquet", "part string, k long, row string"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every if key is None else every.where(F.col("k") == key)


@query("serve_timeline", f"WITH {PANEL_SQL} SELECT k, q, x, n FROM panel")
def serve_timeline(spark, sf_dir, key=None):
    """The quarters of one key in order, or of all keys."""
    rows = panel(spark, sf_dir).select("k", "q", "x", "n")
    return rows if key is None else rows.where(F.col("k") == key).orderBy("q")


@query("serve_in_tier", "SELECT c_custkey, c_acctbal FROM (SELECT *, ntile(4) OVER (ORDER BY c_acctbal DESC, c_custkey) AS t FROM customer) WHERE t = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def serve_in_tier(spark, sf_dir):
    """The twenty first of the top tier."""
    edge = read(spark, sf_dir, "customer")
    n = edge.count()
    return edge.orderBy(F.desc("c_acctbal"), "c_custkey").limit(min(20, -(-n // 4))).select("c_custkey", "c_acctbal")


@query(
    "serve_land_states",
    "SELECT coalesce(a.k, b.k) AS nation, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.k = b.k",
)
def serve_land_states(spark, sf_dir):
    """Register and projects by state, with states that only one of them has."""
    a = read(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nation", "full").na.fill(0, ["n_customers", "n_suppliers"])


@query("serve_agency_bias", f"SELECT c_nationkey AS agency, round(median(b), 4) AS bias, count(*) AS n FROM (SELECT o_custkey, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS b FROM orders WHERE o_orderdate <= TIMESTAMP '{ASOF}' GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def serve_agency_bias(spark, sf_dir):
    """Median over the latest row of each key as known at a date."""
    last = read(spark, sf_dir, "orders").where(F.col("o_orderdate") <= _asof()).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("b"))
    return last.join(read(spark, sf_dir, "customer"), "c_custkey").groupBy(F.col("c_nationkey").alias("agency")).agg(F.round(F.median("b"), 4).alias("bias"), F.count("*").alias("n"))


@query("serve_best_evidence", "SELECT user_id, event_type, arg_max(event_id, row(value, event_id)) AS best, count(*) - 1 AS others FROM events GROUP BY 1, 2")
def serve_best_evidence(spark, sf_dir):
    """The best fact of each dimension and how many others there are."""
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"), (F.count("*") - 1).alias("others"))


@query("dq_plausible_spans", "SELECT p_partkey FROM part WHERE p_size BETWEEN 1 AND 45 AND p_size + p_partkey % 30 BETWEEN 1 AND 60 AND p_partkey % 30 <= 20")
def dq_plausible_spans(spark, sf_dir):
    """Rows whose both ends and span are plausible."""
    end = F.col("p_size") + F.col("p_partkey") % 30
    return read(spark, sf_dir, "part").where(F.col("p_size").between(1, 45) & end.between(1, 60) & (F.abs(end - F.col("p_size")) <= 20)).select("p_partkey")


@query("text_state_key", "SELECT n_nationkey, concat('NATION AND ', n_nationkey) AS key FROM nation")
def text_state_key(spark, sf_dir):
    """A key that compares state names however they are spelt."""
    name = F.concat(F.lit("  nation &  "), F.regexp_extract("n_name", r"(\d+)", 1), F.lit(" "))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.trim(F.regexp_replace(F.replace(F.upper(name), F.lit("&"), F.lit("AND")), r"\s+", " ")).alias("key"))


@query("text_last_milestone", f"SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '{ASOF}' THEN CAST(o_orderdate + INTERVAL 30 DAY AS DATE) WHEN o_orderdate <= TIMESTAMP '{ASOF}' THEN CAST(o_orderdate AS DATE) END AS last FROM orders")
def text_last_milestone(spark, sf_dir):
    """The last date up to a day that a free-text cell names."""
    fmt = lambda d: F.date_format(d, "dd-MM-yyyy")
    cell = F.concat(F.lit("sought on "), fmt("o_orderdate"), F.lit("; replied "), fmt(F.expr("o_orderdate + INTERVAL 30 DAYS")), F.lit("."))
    dates = F.transform(F.regexp_extract_all(cell, F.lit(r"\d{2}-\d{2}-\d{4}"), F.lit(0)), lambda d: F.try_to_timestamp(d, F.lit("dd-MM-yyyy")).cast("date"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_max(F.filter(dates, lambda d: d <= _asof().cast("date"))).alias("last"))


@query("agg_indicator_map", "SELECT event_type AS indicator, CASE WHEN event_type LIKE '%e%r%' THEN 'k_er' WHEN event_type LIKE '%c%' THEN 'k_c' ELSE 'other' END AS key, count(*) AS n, strftime(min(ts), '%Y-%m') AS first, strftime(max(ts), '%Y-%m') AS last FROM events GROUP BY 1, 2")
def agg_indicator_map(spark, sf_dir):
    """Indicators with their keys by the first keyword, counts and months."""
    key = F.when(F.col("event_type").like("%e%r%"), "k_er").when(F.col("event_type").like("%c%"), "k_c").otherwise("other")
    month = lambda c: F.date_format(c, "yyyy-MM")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("indicator"), key.alias("key")).agg(F.count("*").alias("n"), month(F.min("ts")).alias("first"), month(F.max("ts")).alias("last"))


#: Lines that a task of the roads' rollup takes, about: its memory does not grow with the table.
LINES_A_TASK = 500_000


@query("join_road_rollup", "SELECT s_nationkey AS road, p_brand AS district, count(DISTINCT l_partkey) AS stretches, CAST(sum(p_size) AS BIGINT) AS km FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY GROUPING SETS ((s_nationkey), (s_nationkey, p_brand))")
def join_road_rollup(spark, sf_dir):
    """Stretches rolled up by road and by road and district, each (road, stretch) pair once.

    Lines are dealt by part once; pairs, roads of a part and both levels are then counted in place, with no copy of a row a level."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    dealt = lines.repartition(max(lines.count() // LINES_A_TASK, 8), "p_partkey").distinct()
    of_part = dealt.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("road")), "s_suppkey").groupBy("road", "p_partkey").agg(F.count("*").alias("pairs"))
    rows = of_part.join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("district"), "p_size"), "p_partkey")

    def level(*keys: str):
        parts = rows.groupBy(*keys, "p_partkey").agg(F.sum(F.col("pairs") * F.col("p_size")).alias("km"))
        return parts.groupBy(*keys).agg(F.count("p_partkey").alias("stretches"), F.sum("km").alias("km"))

    return level("road").select("road", F.lit(None).cast("string").alias("district"), "stretches", "km").unionByName(level("road", "district"))


@query(
    "serve_alert_acks",
    """WITH a AS (SELECT event_id AS alert, user_id, ts FROM events WHERE event_type = 'error'), k AS (SELECT user_id, min(ts) AS acked_at, arg_min(event_id, row(ts, event_id)) AS by_event FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT alert, acked_at, by_event FROM a LEFT JOIN k USING (user_id) WHERE alert % 2 = 0""",
)
def serve_alert_acks(spark, sf_dir):
    """Alerts with the first acknowledgement only."""
    events = read(spark, sf_dir, "events")
    acks = events.where("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("acked_at"), F.min_by("event_id", F.struct("ts", "event_id")).alias("by_event"))
    alerts = events.where("event_type = 'error' AND event_id % 2 = 0").select(F.col("event_id").alias("alert"), "user_id")
    return alerts.join(acks, "user_id", "left").select("alert", "acked_at", "by_event")


@query("serve_watched", "SELECT user_id, min(ts) AS first_watched, count(*) FILTER (WHERE value > 100) AS severe FROM events WHERE event_type <> 'click' GROUP BY 1 HAVING count(*) FILTER (WHERE value > 100) > 0")
def serve_watched(spark, sf_dir):
    """Watched keys by when they were first watched, with their severe links."""
    rows = read(spark, sf_dir, "events").where("event_type <> 'click'")
    return rows.groupBy("user_id").agg(F.min("ts").alias("first_watched"), F.count_if(F.col("value") > 100).alias("severe")).where("severe > 0").orderBy("first_watched", "user_id")


@query(
    "set_backfill",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END, CASE WHEN year(o_orderdate) < 1997 THEN 'early' ELSE 'late' END) AS lineage FROM orders",
)
def set_backfill(spark, sf_dir):
    """Missing lineage filled by the rule of the period; what is there stays."""
    rules = spark.createDataFrame([(y, "early" if y < 1997 else "late") for y in range(1990, 2010)], "y int, rule string")
    rows = read(spark, sf_dir, "orders").withColumns({"y": F.year("o_orderdate"), "given": F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))})
    return rows.join(F.broadcast(rules), "y", "left").select("o_orderkey", F.coalesce("given", "rule").alias("lineage"))


@query(
    "serve_threshold_flags",
    """WITH t AS (SELECT c_custkey, unnest([{'f': 'balance', 'p': c_acctbal / 10000}, {'f': 'nation', 'p': c_nationkey / 25.0}]) AS s FROM customer)
    SELECT c_custkey, s.f AS flag, CASE WHEN s.p >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM t WHERE s.p >= 0.5""",
)
def serve_threshold_flags(spark, sf_dir):
    """Flags at 0.50 and 0.70 with their severity, one row each."""
    both = F.array(F.struct(F.lit("balance").alias("flag"), (F.col("c_acctbal") / 10000).alias("p")), F.struct(F.lit("nation").alias("flag"), (F.col("c_nationkey") / 25.0).alias("p")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.explode(both).alias("s")).where("s.p >= 0.5")
    return rows.select("c_custkey", "s.flag", F.when(F.col("s.p") >= 0.7, "high").otherwise("medium").alias("severity"))


@query(
    "text_aliases",
    "SELECT p_partkey, concat_ws(';', p_name, upper(concat(left(split_part(p_name, ' ', 1), 1), left(split_part(p_name, ' ', 2), 1))), split_part(p_name, ' ', 2)) AS aliases FROM part",
)
def text_aliases(spark, sf_dir):
    """Search aliases of a name: itself, its initials and its last word."""
    words = F.split("p_name", " ")
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(";", "p_name", initials, F.element_at(words, -1)).alias("aliases"))


@query(
    "rag_chunks",
    "WITH s AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) SELECT conv_id, CAST(floor((upto - n) / 800) AS BIGINT) AS chunk, count(*) AS parts, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY 1, 2",
)
def rag_chunks(spark, sf_dir):
    """Consecutive sections packed into chunks: a section belongs to the chunk in which it begins."""
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").withColumn("n", F.length("text")).withColumn("chunk", F.floor((upto - F.col("n")) / 800))
    return rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("parts"), F.sum("n").alias("chars"))


@query(
    "rag_changed_chunks",
    "WITH s AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE conv_id % 5 > 0 AND text IS NOT NULL) SELECT conv_id, turn, CASE WHEN h IS NULL THEN 'new' ELSE 'reused' END AS state FROM conversations LEFT JOIN s ON md5(text) = h",
)
def rag_changed_chunks(spark, sf_dir):
    """Chunks whose content the saved index (of four in five conversations) has keep their vectors, wherever they stand; the rest, and nulls, are to be embedded."""
    from panelwright.sources.scratch import stored

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("hash"))
    index = stored(rows.where("conv_id % 5 > 0 AND hash IS NOT NULL").select("hash", F.lit("reused").alias("state")).distinct())
    return rows.join(index, "hash", "left").select("conv_id", "turn", F.coalesce("state", F.lit("new")).alias("state"))
