"""Composites: curves by fit year, notices, cards, monthly reads, story merges, evidence and cluster resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import ratio
from panelwright.plans.panel import PANEL_SQL, panel
from panelwright.plans.registry import query
from panelwright.sources import scratch, sinks
from panelwright.sources.tables import read


@query(
    "panel_scurve_by_year",
    f"""WITH {PANEL_SQL}, y AS (SELECT k, q, q // 4 AS y, x FROM panel), fits AS (SELECT DISTINCT y AS fit FROM y),
    r AS (SELECT fit, k, q - min(q) OVER w AS age, x / nullif(max(x) OVER w, 0) AS part FROM y JOIN fits ON y < fit WINDOW w AS (PARTITION BY fit, k)),
    b AS (SELECT fit, CASE WHEN age >= 16 THEN 4 WHEN age >= 8 THEN 3 WHEN age >= 4 THEN 2 WHEN age >= 2 THEN 1 ELSE 0 END AS bin, count(*) AS n, median(part) AS part FROM r GROUP BY 1, 2)
    SELECT fit, bin, n, round(max(part) OVER (PARTITION BY fit ORDER BY bin), 9) AS curve FROM b""",
)
def panel_scurve_by_year(spark, sf_dir):
    """The curve of shares of the peak by age, for each fit year from the years before it only."""
    rows = panel(spark, sf_dir).select("k", "q", F.expr("q div 4").cast("int").alias("y"), "x")
    fits = rows.select(F.col("y").alias("fit")).distinct()
    w = Window.partitionBy("fit", "k")
    known = rows.join(F.broadcast(fits), F.col("y") < F.col("fit"))  # one row a calendar year
    aged = known.select("fit", (F.col("q") - F.min("q").over(w)).alias("age"), ratio(F.col("x"), F.max("x").over(w)).alias("part"))
    band = F.when(F.col("age") >= 16, 4).when(F.col("age") >= 8, 3).when(F.col("age") >= 4, 2).when(F.col("age") >= 2, 1).otherwise(0)
    by = aged.groupBy("fit", band.alias("bin")).agg(F.count("*").alias("n"), F.percentile("part", 0.5).alias("part"))
    return by.select("fit", "bin", "n", F.round(F.max("part").over(Window.partitionBy("fit").orderBy("bin")), 9).alias("curve"))


@query(
    "win_failure_lock",
    """WITH f AS (SELECT user_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS secs FROM events WHERE event_type = 'error'),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY secs RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n FROM f)
    SELECT event_id, n AS failures, CASE WHEN n >= 3 THEN secs + 604800 END AS locked_until FROM n""",
)
def win_failure_lock(spark, sf_dir):
    """A burst of failures locks its user: 3 within a week, for a week from the last of them."""
    week = 7 * 86400
    rows = read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-week, 0))
    return rows.withColumn("failures", n).select("event_id", "failures", F.when(F.col("failures") >= 3, F.col("at") + week).alias("locked_until"))


@query(
    "src_clamped_predictions",
    """WITH p AS (SELECT user_id, event_type, event_id, CASE WHEN value / 200 BETWEEN 0 AND 1 THEN value / 200 WHEN value / 200 BETWEEN -0.01 AND 1.01 THEN greatest(0.0, least(1.0, value / 200)) END AS p FROM events),
    l AS (SELECT user_id, event_type, arg_max(p, event_id) AS p FROM p WHERE p IS NOT NULL GROUP BY 1, 2)
    SELECT c_custkey, event_type, round(p, 9) AS p FROM l JOIN customer ON user_id = c_custkey""",
)
def src_clamped_predictions(spark, sf_dir):
    """Loaded probabilities: those just outside 0 to 1 are clamped, others are no predictions; known keys, the latest wins."""
    p = F.col("value") / 200
    clean = F.when(p.between(-0.01, 1.01), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", clean.alias("p")).where("p IS NOT NULL")
    latest = rows.groupBy("user_id", "event_type").agg(F.max_by("p", "event_id").alias("p"))
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return latest.join(known, "user_id").select(F.col("user_id").alias("c_custkey"), "event_type", F.round("p", 9).alias("p"))


@query(
    "text_place_words",
    """WITH w AS (SELECT DISTINCT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS word FROM documents WHERE lang IS NOT NULL)
    SELECT word, min(lang) AS place FROM w GROUP BY word HAVING count(*) = 1""",
)
def text_place_words(spark, sf_dir):
    """Words that one group alone uses, so that they point to it."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))
    used = read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", words.alias("word")).select("lang", F.lower("word").alias("word")).distinct()
    return used.groupBy("word").agg(F.min("lang").alias("place"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(
    "serve_evidence_pack",
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'risk' WHEN 'purchase' THEN 'outcome' ELSE 'context' END AS part, event_id, value FROM events)
    SELECT user_id, part, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS citable, CAST(sum(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM e GROUP BY 1, 2""",
)
def serve_evidence_pack(spark, sf_dir):
    """Evidence by part, what of it may be cited, and a digest that no order changes: it tells whether a summary is stale."""
    part = F.when(F.col("event_type") == "error", "risk").when(F.col("event_type") == "purchase", "outcome").otherwise("context")
    hashed = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    rows = read(spark, sf_dir, "events").groupBy("user_id", part.alias("part"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("citable"), F.sum(hashed).alias("digest"))


@query(
    "set_daily_snapshot",
    """WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type AS state, event_id, event_id % 3 = 0 AS here FROM events),
    s AS (SELECT d, state, bool_or(here) AS here, count(*) FILTER (WHERE here) AS old, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT d, state, CASE WHEN here THEN old ELSE n END AS n, CASE WHEN here THEN 'kept' ELSE 'new' END AS status FROM s""",
)
def set_daily_snapshot(spark, sf_dir):
    """One snapshot a day and state: a day that is there stays, others come in."""
    rows = read(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("event_type").alias("state"), (F.col("event_id") % 3 == 0).alias("here"))
    table = scratch.place(spark)
    sinks.insert_once(rows.where("here").groupBy("d", "state").agg(F.count("*").alias("n"), F.lit("kept").alias("status")), table, ["d", "state"])
    sinks.insert_once(rows.groupBy("d", "state").agg(F.count_if(~F.col("here")).alias("n"), F.lit("new").alias("status")).where("n > 0"), table, ["d", "state"])
    return spark.read.parquet(table)


@query(
    "rag_saved_vectors",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT md5(text) AS h, min(doc_id) AS saved FROM t WHERE doc_id % 5 > 0 GROUP BY 1)
    SELECT doc_id, saved, saved IS NULL AS to_embed FROM t LEFT JOIN s ON md5(text) = h""",
)
def rag_saved_vectors(spark, sf_dir):
    """The saved row whose vector a text may reuse as their content hashes agree; the others are to be embedded."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    saved = rows.where("doc_id % 5 > 0").groupBy("h").agg(F.min("doc_id").alias("saved"))
    return rows.join(saved, "h", "left").select("doc_id", "saved", F.col("saved").isNull().alias("to_embed"))


@query(
    "agg_notice_backtest",
    f"""WITH {PANEL_SQL}, f AS (SELECT q, x < lag(x) OVER w AS notice, max(x) OVER (PARTITION BY k ORDER BY q RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING) < x AS fell FROM panel WINDOW w AS (PARTITION BY k ORDER BY q)),
    g AS (SELECT q, count(*) AS n, count(*) FILTER (WHERE notice) AS noticed, count(*) FILTER (WHERE fell) AS events, count(*) FILTER (WHERE notice AND fell) AS hits FROM f WHERE notice IS NOT NULL AND fell IS NOT NULL GROUP BY q)
    SELECT q, n, noticed, round(hits / noticed, 9) AS precision, round(hits / nullif(events, 0), 9) AS recall, round(hits / noticed / nullif(events / n, 0), 9) AS lift FROM g WHERE noticed >= 10""",
)
def agg_notice_backtest(spark, sf_dir):
    """Whether an early notice (a fall on the last report) came before no better value in 4 quarters, by quarter with 10 notices."""
    key = Window.partitionBy("k").orderBy("q")
    notice = F.col("x") < F.lag("x").over(key)
    fell = F.max("x").over(key.rangeBetween(1, 4)) < F.col("x")
    rows = panel(spark, sf_dir).select("q", notice.alias("notice"), fell.alias("fell")).where("notice IS NOT NULL AND fell IS NOT NULL")
    by = rows.groupBy("q").agg(F.count("*").alias("n"), F.count_if("notice").alias("noticed"), F.count_if("fell").alias("events"), F.count_if(F.expr("notice AND fell")).alias("hits")).where("noticed >= 10")
    precision = F.col("hits") / F.col("noticed")
    return by.select("q", "n", "noticed", F.round(precision, 9).alias("precision"), F.round(ratio(F.col("hits"), F.col("events")), 9).alias("recall"), F.round(ratio(precision, F.col("events") / F.col("n")), 9).alias("lift"))


@query(
    "serve_factor_cards",
    """WITH f AS (SELECT l_suppkey AS k, l_partkey AS factor, sum(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(weight, 2) DESC, factor) AS place, weight / sum(weight) OVER (PARTITION BY k) AS part, count(*) OVER (PARTITION BY k) AS n FROM f)
    SELECT k, place, factor, round(part, 9) AS part, n - least(n, 3) AS others FROM r WHERE place <= 3""",
)
def serve_factor_cards(spark, sf_dir):
    """The 3 heaviest factors of each key, their shares and how many others there are."""
    f = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("factor")).agg(F.sum("l_extendedprice").alias("weight"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.round("weight", 2).desc(), "factor"))
    totals = f.groupBy("k").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    top = f.withColumn("place", place).where("place <= 3")
    return top.join(totals, "k").select("k", "place", "factor", F.round(F.col("weight") / F.col("total"), 9).alias("part"), (F.col("n") - F.least("n", F.lit(3))).alias("others"))


@query(
    "panel_sector_monthly",
    """WITH m AS (SELECT c_nationkey AS sector, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT a.sector, a.m, round(a.value, 2) AS value, round(a.value / b.value - 1, 9) AS growth, round(a.value - c.value, 2) AS change FROM m a LEFT JOIN m b ON a.sector = b.sector AND b.m = a.m - 12 LEFT JOIN m c ON a.sector = c.sector AND c.m = a.m - 1""",
)
def panel_sector_monthly(spark, sf_dir):
    """Sector by month with growth on the same month a year before and the change on the month before, null where that is missing."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("sector"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m")
    m = read(spark, sf_dir, "orders").join(keys, "o_custkey").groupBy("sector", month).agg(F.sum("o_totalprice").alias("value"))
    by = Window.partitionBy("sector").orderBy("m")
    back = lambda n: F.max("value").over(by.rangeBetween(-n, -n))
    return m.select("sector", "m", F.round("value", 2).alias("value"), F.round(F.col("value") / back(12) - 1, 9).alias("growth"), F.round(F.col("value") - back(1), 2).alias("change"))


@query(
    "set_story_merge",
    """WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS origin, regexp_replace(trim(text, ' '), ' +', ' ', 'g') AS story FROM documents WHERE text IS NOT NULL)
    SELECT arg_min(id, row(origin, id)) AS id, min(origin) AS origin, count(*) AS copies, count(DISTINCT origin) AS origins FROM s GROUP BY md5(story)""",
)
def set_story_merge(spark, sf_dir):
    """Stories of two origins, each once: the first origin's copy goes before the other's."""
    story = F.md5(F.regexp_replace(F.trim("text"), " +", " "))
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("origin"), story.alias("story"))
    both = rows.groupBy("story").agg(F.min(F.struct("origin", "id")).alias("first"), F.count("*").alias("copies"), (F.max("origin") - F.min("origin") + 1).cast("long").alias("origins"))
    return both.select("first.id", "first.origin", "copies", "origins")


@query(
    "text_sentence_facts",
    """SELECT conv_id, turn, len(regexp_extract_all(text, '[^.!?]*[.!?]')) AS sentences, len(regexp_extract_all(text, '[^.!?]*[0-9][^.!?]*[.!?]')) AS facts FROM conversations WHERE text IS NOT NULL""",
)
def text_sentence_facts(spark, sf_dir):
    """Sentences and those with a figure, worked out once for each distinct text and joined back."""
    rows = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text", F.xxhash64("text").alias("h"), F.md5("text").alias("h2"))
    found = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("long")
    once = rows.groupBy("h", "h2").agg(F.first("text").alias("text"))  # equal hashes, equal texts
    facts = once.select("h", "h2", found("[^.!?]*[.!?]").alias("sentences"), found("[^.!?]*[0-9][^.!?]*[.!?]").alias("facts"))
    return rows.drop("text").join(facts, ["h", "h2"]).select("conv_id", "turn", "sentences", "facts")


#: Upper ends of the chances of 0, 1, 2 ... draws of a cluster (Poisson of mean 1), to four places.
_DRAWS = (0.3679, 0.7358, 0.9197, 0.9810, 0.9963, 0.9994)
_TIMES = "CASE " + " ".join(f"WHEN u < {p} THEN {n}" for n, p in enumerate(_DRAWS)) + f" ELSE {len(_DRAWS)} END"


@query(
    "agg_cluster_bootstrap",
    f"""WITH c AS (SELECT l_suppkey AS k, l_linestatus AS s, l_quantity > 25 AS arm, sum(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    w AS (SELECT k, b, {_TIMES} AS t FROM (SELECT k, b, CAST('0x' || substr(md5(k || ':' || b), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT DISTINCT k FROM c), range(200) r(b))),
    m AS (SELECT b, s, sum(t * v) FILTER (WHERE arm) / sum(t * n) FILTER (WHERE arm) - sum(t * v) FILTER (WHERE NOT arm) / sum(t * n) FILTER (WHERE NOT arm) AS d, sum(t * n) AS n FROM c JOIN w USING (k) GROUP BY 1, 2),
    r AS (SELECT b, sum(d * n) / sum(n) AS d FROM m WHERE d IS NOT NULL GROUP BY b)
    SELECT round(quantile_cont(d, 0.05), 9) AS lo, round(quantile_cont(d, 0.5), 9) AS middle, round(quantile_cont(d, 0.95), 9) AS hi FROM r""",
)
def agg_cluster_bootstrap(spark, sf_dir):
    """90% interval of a difference of means, averaged over strata, by 200 resamples of whole clusters.

    Sums by cluster come first, so only they meet the resamples. A cluster's draws in a resample come from a hash.
    """
    arm = F.when(F.col("l_quantity") > 25, "a").otherwise("b")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linestatus").alias("s"), arm.alias("arm"), F.col("l_discount").alias("v"))
    of = lambda a: [F.sum(F.when(F.col("arm") == a, F.col("v"))).alias(f"v_{a}"), F.count_if(F.col("arm") == a).alias(f"n_{a}")]
    sums = rows.groupBy("k", "s").agg(*of("a"), *of("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(199))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "k", "b")), 1, 8), 16, 10).cast("long") / 4294967296.0
    drawn = sums.withColumn("u", u).withColumn("t", F.expr(_TIMES))
    total = lambda c: F.sum(F.col("t") * F.col(c))
    by = drawn.groupBy("b", "s").agg((ratio(total("v_a"), total("n_a")) - ratio(total("v_b"), total("n_b"))).alias("d"), (total("n_a") + total("n_b")).alias("n"))
    each = by.where("d IS NOT NULL").groupBy("b").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("d"))
    cut = lambda p: F.round(F.percentile("d", p), 9)
    return each.agg(cut(0.05).alias("lo"), cut(0.5).alias("middle"), cut(0.95).alias("hi"))


@query(
    "text_grounded",
    """WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[A-Za-z]{3,}')) AS words FROM conversations WHERE text IS NOT NULL)
    SELECT s.conv_id, s.turn, len(list_intersect(s.words, o.words)) AS own, len(list_intersect(s.words, x.words)) AS other, len(list_intersect(s.words, o.words)) > len(list_intersect(s.words, x.words)) AS grounded
    FROM w s JOIN w o ON s.role = 'assistant' AND o.conv_id = s.conv_id AND o.turn = s.turn - 1 JOIN w x ON x.conv_id = s.conv_id + 1 AND x.turn = s.turn - 1""",
)
def text_grounded(spark, sf_dir):
    """Whether an answer has more words of what it answers than of another item."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))
    rows = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", words.alias("words"))
    own = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("o"))
    other = rows.select((F.col("conv_id") - 1).alias("conv_id"), (F.col("turn") + 1).alias("turn"), F.col("words").alias("x"))
    both = rows.where("role = 'assistant'").join(own, ["conv_id", "turn"]).join(other, ["conv_id", "turn"])
    shared = lambda c: F.size(F.array_intersect("words", c)).cast("long")
    return both.select("conv_id", "turn", shared("o").alias("own"), shared("x").alias("other")).withColumn("grounded", F.col("own") > F.col("other"))


@query(
    "src_registered",
    "SELECT sha256(text) AS sha, min(doc_id) AS source_id, count(*) AS runs, max(len(string_split(text, chr(10)))) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def src_registered(spark, sf_dir):
    """Sources by the hash of their content, the first id that brought it, how often it came and its rows."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha"), "doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"))
    registered, runs = scratch.place(spark), rows.groupBy("sha").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("runs"), F.max("n").alias("n_rows"))
    sinks.insert_once(runs.select("sha", "source_id", "n_rows"), registered, ["sha"])
    return spark.read.parquet(registered).join(runs.select("sha", "runs"), "sha").select("sha", "source_id", "runs", "n_rows")


@query(
    "sink_timeline",
    """WITH t AS (SELECT c_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey AS i, o_totalprice AS v, o_orderkey % 4 = 0 AS here FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT k, d, arg_min(i, row(CAST(NOT here AS INTEGER), i)) AS i, arg_min(v, row(CAST(NOT here AS INTEGER), i)) AS v FROM t GROUP BY 1, 2""",
)
def sink_timeline(spark, sf_dir):
    """History loaded for known keys: a (key, day) that is there stays, the first of new ones comes in."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")).join(keys, "k")
    table = scratch.place(spark)
    sinks.insert_once(t.where("i % 4 = 0"), table, ["k", "d"])
    sinks.insert_once(t.where("i % 4 > 0"), table, ["k", "d"])
    return spark.read.parquet(table)
