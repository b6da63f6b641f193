"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import entity, relational, temporal
from panelwright.plans.registry import query
from panelwright.sources.tables import read


@query("join_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_lookup(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    places = relational.lookup(nations, read(spark, sf_dir, "region"), ["r_regionkey"]).withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.lookup(read(spark, sf_dir, "customer"), places, ["c_nationkey"]).select("c_custkey", "n_name", "r_name")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark, sf_dir):
    open_ = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(open_, "c_custkey", "left_semi").select("c_custkey")


@query("join_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_anti(spark, sf_dir):
    large = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").join(large, "p_partkey", "left_anti").select("p_partkey")


@query(
    "join_full",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT k, coalesce(orders, 0) AS orders, coalesce(errors, 0) AS errors FROM a FULL JOIN b USING (k)""",
)
def join_full(spark, sf_dir):
    a = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    b = read(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("errors"))
    return a.join(b, "k", "full").fillna(0, ["orders", "errors"])


@query(
    "join_agree_or_null",
    """WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderstatus) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT k, coalesce(a.v, b.v) AS v, coalesce(a.v <> b.v, false) AS conflict FROM a FULL JOIN b USING (k)""",
)
def join_agree_or_null(spark, sf_dir):
    side = lambda n: read(spark, sf_dir, "orders").where(F.col("o_orderkey") % n == 0).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderstatus").alias("v"))
    return relational.agree_or_null(side(2), side(3), ["k"], "v")


@query(
    "join_range",
    """SELECT o_orderkey, count(*) AS shipped, max(l_shipdate) AS last_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY 1""",
)
def join_range(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    near = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 60 days")
    return temporal.range_join(read(spark, sf_dir, "orders"), lines, ["o_orderkey"], near).groupBy("o_orderkey").agg(F.count("*").alias("shipped"), F.max("l_shipdate").alias("last_ship"))


@query(
    "join_overlap",
    """WITH a AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderkey % 97 AS lo, o_orderkey % 97 + 5 + o_orderkey % 7 AS hi FROM orders WHERE o_orderstatus = 'P'),
    b AS (SELECT o_custkey AS k, o_orderkey AS j, o_orderkey % 89 AS lo_r, o_orderkey % 89 + 4 + o_orderkey % 11 AS hi_r FROM orders WHERE o_orderstatus = 'F')
    SELECT i, j, least(hi, hi_r) - greatest(lo, lo_r) AS shared FROM a JOIN b USING (k) WHERE least(hi, hi_r) - greatest(lo, lo_r) > 0 AND least(hi, hi_r) - greatest(lo, lo_r) >= least(3, 0.5 * least(hi - lo, hi_r - lo_r))""",
)
def join_overlap(spark, sf_dir):
    """Stretches of the same key that share three units or half the shorter one."""
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    a = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), key.alias("i"), (key % 97).alias("lo"), (key % 97 + 5 + key % 7).alias("hi"))
    b = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), key.alias("j"), (key % 89).alias("lo"), (key % 89 + 4 + key % 11).alias("hi"))
    return temporal.overlap_join(a, b, ["k"], "lo", "hi", 3.0).select("i", "j", "shared")


@query(
    "join_fallback",
    """WITH l AS (SELECT o_orderkey, o_totalprice, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
    a AS (SELECT c_nationkey, c_mktsegment, avg(o_totalprice) AS m FROM l GROUP BY 1, 2 HAVING count(*) >= 150), b AS (SELECT c_nationkey, avg(o_totalprice) AS m FROM l GROUP BY 1 HAVING count(*) >= 600), g AS (SELECT avg(o_totalprice) AS m FROM l)
    SELECT o_orderkey, round(coalesce(a.m, b.m, g.m), 6) AS m, CASE WHEN a.m IS NOT NULL THEN 'both' WHEN b.m IS NOT NULL THEN 'nation' ELSE 'all' END AS m_basis
    FROM l LEFT JOIN a USING (c_nationkey, c_mktsegment) LEFT JOIN b USING (c_nationkey) CROSS JOIN g""",
)
def join_fallback(spark, sf_dir):
    """Mean of the narrowest group with enough rows, and which group that was."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_nationkey", "c_mktsegment")
    mean = lambda *keys: rows.groupBy(*keys).agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    levels = [
        ("both", mean("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], F.col("n") >= 150),
        ("nation", mean("c_nationkey"), ["c_nationkey"], F.col("n") >= 600),
        ("all", mean(), [], F.lit(True)),
    ]
    return relational.fallback_lookup(rows, levels, "m").select("o_orderkey", F.round("m", 6).alias("m"), "m_basis")


@query(
    "join_precedence",
    """WITH c AS (SELECT l_orderkey AS o, l_suppkey AS s, CASE WHEN l_quantity > 40 THEN 1 WHEN l_discount > 0.05 THEN 2 ELSE 3 END AS step FROM lineitem), b AS (SELECT *, min(step) OVER (PARTITION BY o) AS best FROM c)
    SELECT o, s, step, count(*) AS n FROM b WHERE step = best GROUP BY 1, 2, 3""",
)
def join_precedence(spark, sf_dir):
    step = F.when(F.col("l_quantity") > 40, 1).when(F.col("l_discount") > 0.05, 2).otherwise(3)
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), step.alias("step"))
    return relational.precedence(links, ["o"], "step").groupBy("o", "s", "step").agg(F.count("*").alias("n"))


@query(
    "join_explode",
    """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(*) AS parts, round(avg(p_retailprice), 6) AS price FROM w JOIN part USING (p_partkey) GROUP BY 1""",
)
def join_explode(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    words = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.join(parts, "p_partkey").groupBy("word").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@query(
    "join_rule_table",
    """WITH r(rule, segment, lo, hi) AS (VALUES ('a', 'BUILDING', 0, 3000), ('b', 'BUILDING', 3000, 1e9), ('c', NULL, -1e9, 0), ('d', 'MACHINERY', 0, 1e9))
    SELECT c_custkey, count(*) AS rules, min(rule) AS first FROM customer JOIN r ON (segment IS NULL OR segment = c_mktsegment) AND c_acctbal >= lo AND c_acctbal < hi GROUP BY 1""",
)
def join_rule_table(spark, sf_dir):
    """Rows matched to a fixed table of rules with a category, where it has one, and a band."""
    rules = spark.createDataFrame([("a", "BUILDING", 0.0, 3000.0), ("b", "BUILDING", 3000.0, 1e9), ("c", None, -1e9, 0.0), ("d", "MACHINERY", 0.0, 1e9)], "rule string, segment string, lo double, hi double")
    match = (F.col("segment").isNull() | (F.col("segment") == F.col("c_mktsegment"))) & (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") < F.col("hi"))
    return read(spark, sf_dir, "customer").join(F.broadcast(rules), match).groupBy("c_custkey").agg(F.count("*").alias("rules"), F.min("rule").alias("first"))


@query(
    "join_diff",
    """WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0)
    SELECT k, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""",
)
def join_diff(spark, sf_dir):
    """What changed between two snapshots."""
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer")
    a = rows.where(key % 10 != 0).select(key.alias("k"), F.col("c_acctbal").alias("v"))
    b = rows.where(key % 11 != 0).select(key.alias("k"), F.when(key % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"))
    return relational.diff(a, b, ["k"], ["v"]).select("k", "change")


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(
    "set_priority_union",
    """WITH u AS (SELECT o_custkey AS k, o_orderkey AS i, 0 AS r FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O')
    SELECT k, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM u) WHERE n = 1""",
)
def set_priority_union(spark, sf_dir):
    side = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"))
    return relational.priority_union([side("P"), side("O")], ["k"], ["i"]).select("k", "i")


@query(
    "set_replace_keys",
    """WITH n AS (SELECT o_custkey AS k, o_orderkey AS i FROM orders WHERE o_orderstatus = 'P'), o AS (SELECT o_custkey AS k, o_orderkey AS i FROM orders WHERE o_orderpriority LIKE '1%')
    SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n""",
)
def set_replace_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    pick = lambda c: rows.where(c).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"))
    return relational.replace_keys(pick("o_orderpriority LIKE '1%'"), pick("o_orderstatus = 'P'"), ["k"])


@query(
    "set_equal_members",
    """WITH m AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1) SELECT s, count(*) AS keys, min(k) AS first FROM m GROUP BY s""",
)
def set_equal_members(spark, sf_dir):
    sets = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("s"))
    return sets.groupBy("s").agg(F.count("*").alias("keys"), F.min("k").alias("first"))


@query("set_version_digest")
def set_version_digest(spark, sf_dir):
    """Content version of the orders: rows and an order-free hash."""
    return relational.digest(read(spark, sf_dir, "orders"))


@query(
    "er_block",
    """WITH t AS (SELECT page_id AS id, unnest(list_distinct(string_split_regex(lower(url), '[^a-z0-9]+'))) AS token FROM pages), d AS (SELECT token, count(*) AS df FROM t WHERE token <> '' GROUP BY token HAVING count(*) BETWEEN 2 AND greatest(60, (SELECT count(*) FROM pages) // 50)),
    n AS (SELECT count(*) AS n FROM pages), s AS (SELECT a.id, b.id AS other, count(*) AS shared, sum(ln(n.n / d.df)) AS weight FROM t a JOIN d USING (token) JOIN t b USING (token) CROSS JOIN n WHERE a.id <> b.id GROUP BY 1, 2)
    SELECT id, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, other) AS p FROM s) WHERE p <= 5""",
)
def er_block(spark, sf_dir):
    """Candidates of each page by shared distinctive tokens of the url, weighted by rarity."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    return entity.candidates(pages, "id", "name", most_df=60, top=5).select("id", "other", "shared")


@query(
    "er_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.c_custkey AS u, b.c_custkey AS v FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND abs(a.c_acctbal - b.c_acctbal) < 150 AND a.c_custkey <> b.c_custkey),
    r AS (SELECT c_custkey AS u, c_custkey AS root FROM customer UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u WHERE r.root < e.v)
    SELECT u AS c_custkey, min(root) AS root FROM r GROUP BY u""",
)
def er_components(spark, sf_dir):
    """Single-linkage clusters of like customers."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return entity.chain_clusters(rows, "c_custkey", ["c_nationkey", "c_mktsegment"], "c_acctbal", 150.0).select("c_custkey", "root")


@query("er_resolve")
def er_resolve(spark, sf_dir):
    """Each page's best earlier match by url, code and size, accepted, in review or new."""
    code = F.regexp_extract("url", r"/(\w+)/\d+", 1)
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"), code.alias("code"), F.length("html").alias("cost"))
    return entity.resolve(pages, "id", "name", "code", "cost")


@query("er_graph_components")
def er_graph_components(spark, sf_dir):
    """Components of customers (even nodes) and suppliers (odd) linked by the customers' orders of the suppliers' items."""
    customers = read(spark, sf_dir, "customer").select((2 * F.col("c_custkey")).alias("u"))
    suppliers = read(spark, sf_dir, "supplier").select((2 * F.col("s_suppkey") + 1).alias("u"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (2 * F.col("o_custkey")).alias("u"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (2 * F.col("l_suppkey") + 1).alias("v"))
    links = orders.join(items, "o_orderkey").select("u", "v")
    # A link to itself keeps a node that has no other.
    return entity.components(links.unionByName(customers.unionByName(suppliers).withColumn("v", F.col("u"))))
