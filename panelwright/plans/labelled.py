"""Labels, flags, places and shapes of the tables' rows by tables of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import labels as L
from panelwright.plans.registry import query
from panelwright.sources.tables import read

#: Printed labels: sector by language, group by source, indicator by text. The order decides.
RULES = [
    L.Rule("fr_amount", {"lang": "^fr$", "text": "[0-9]{2,}"}),
    L.Rule("fr_total", {"lang": "^fr$", "text": "(?i)^(?:le|la|les)"}),
    L.Rule("fr_other", {"lang": "^fr$"}, {"text": r"\n"}),
    L.Rule("de_main", {"lang": "^de$", "source": "[0-4]|a"}),
    L.Rule("en_token", {"lang": "^en$", "text": "(?i)token|secret"}),
    L.Rule("en_long", {"lang": "^en$", "text": r"\n[^\n]*\n"}, {"source": "^$"}),
    L.Rule("total", {"text": "(?i)^total"}),
]
FLAGS = [("(?i)licen[cs]e", "licensed"), (r"([0-9]{2,4})\.[0-9]+\.", "address:{}"), (r"(?i)token = .([a-z0-9]{2})", "token:{}"), (r"[!?]{2}", "shouted"), (r"#{2,}", "symbols")]
PLACES = {f"NATION{i}": f"Nation {i}" for i in range(20)} | {"NATION20": "Nation 2"}
SPECIAL = {"NATION21": "Abroad"}
WRAPPER = r"(?i)^MULTI[\s-]*PLACES?\s*\((.*)\)$"


def _rules_sql() -> str:
    """The rule table as a CASE of regexp_matches."""
    tests = [(r.value, [f"regexp_matches(coalesce({c}, ''), '{p}')" for c, p in r.has.items()] + [f"NOT regexp_matches(coalesce({c}, ''), '{p}')" for c, p in r.lacks.items()]) for r in RULES]
    return "CASE " + " ".join(f"WHEN {' AND '.join(t)} THEN '{v}'" for v, t in tests) + " END"


@query("text_first_rules", f"SELECT doc_id, {_rules_sql()} AS key FROM documents")
def text_first_rules(spark, sf_dir):
    """The key of the first rule that a document's language, source and text fit."""
    return read(spark, sf_dir, "documents").select("doc_id", L.first_rule({c: F.col(c) for c in ("lang", "source", "text")}, RULES).alias("key"))


@query(
    "text_report_flags",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS b FROM documents), f AS (SELECT doc_id, list_concat(CASE WHEN regexp_matches(b, '(?i)licen[cs]e') THEN ['licensed'] ELSE [] END, ['address:' || x FOR x IN regexp_extract_all(b, '([0-9]{2,4})\.[0-9]+\.', 1)],
    ['token:' || x FOR x IN regexp_extract_all(b, '(?i)token = .([a-z0-9]{2})', 1)], CASE WHEN regexp_matches(b, '[!?]{2}') THEN ['shouted'] ELSE [] END, CASE WHEN regexp_matches(b, '#{2,}') THEN ['symbols'] ELSE [] END) AS l FROM t)
    SELECT doc_id, array_to_string([x FOR x, i IN l IF list_position(l, x) = i], ';') AS flags FROM f""",
)
def text_report_flags(spark, sf_dir):
    """All flags that a document's text raises, in the table's order."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(L.flags(F.col("text"), FLAGS), ";").alias("flags"))


@query(
    "text_place_labels",
    """WITH c AS (SELECT l_orderkey AS k, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS raw FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
    r AS (SELECT k, CASE k % 3 WHEN 0 THEN 'Multi-place (' || raw || ')' WHEN 1 THEN lower(raw) ELSE raw END AS raw, string_split(raw, ', ') AS parts FROM c),
    i AS (SELECT k, raw, [CAST(substr(p, 8) AS INTEGER) FOR p IN parts] AS ids, k % 3 = 0 AS wrapped FROM r),
    m AS (SELECT *, len(ids) AS n, list_bool_and([x <= 20 FOR x IN ids]) AS known, list_sort(list_distinct(['Nation ' || CASE WHEN x = 20 THEN 2 ELSE x END FOR x IN ids])) AS names FROM i)
    SELECT k, CASE WHEN n > 1 AND known THEN 'Several' WHEN n = 1 AND NOT wrapped AND known THEN names[1] WHEN n = 1 AND NOT wrapped AND ids[1] = 21 THEN 'Abroad' ELSE 'Unknown' END AS label,
    CASE WHEN n > 1 AND known THEN array_to_string(names, ';') ELSE '' END AS members, CASE WHEN n > 1 AND known THEN '' WHEN n = 1 AND NOT wrapped AND known THEN 'alias' WHEN n = 1 AND NOT wrapped AND ids[1] = 21 THEN '' ELSE 'unrecognised' END AS note FROM m""",
)
def text_place_labels(spark, sf_dir):
    """The place, or places, that the cell of an order's suppliers names, in three ways of printing."""
    nations = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    cells = read(spark, sf_dir, "lineitem").join(nations, "l_suppkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.sort_array(F.collect_set("n_name")), ", ").alias("raw"))
    printed = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Multi-place ("), "raw", F.lit(")"))).when(F.col("k") % 3 == 1, F.lower("raw")).otherwise(F.col("raw"))
    return cells.select("k", L.place_label(printed, PLACES, SPECIAL, "Several", "Unknown", WRAPPER).alias("p")).select("k", "p.*")


@query(
    "text_shapes",
    """WITH s AS (SELECT p_partkey, p_type, p_name, regexp_matches(p_name, 'ring|bolt') OR p_type = 'PROMO' OR (NOT regexp_matches(p_name, 'widget') AND p_type IN ('ECONOMY', 'SMALL')) AS linear FROM part)
    SELECT p_partkey, CASE WHEN linear THEN 'Linear' ELSE 'Non-Linear' END AS shape, regexp_matches(p_type, 'STANDARD') OR (regexp_matches(p_name, 'red|steel') AND NOT linear) AS kind FROM s""",
)
def text_shapes(spark, sf_dir):
    """Whether a part is a line by name and type, and whether it is of a kind."""
    shape = L.shape(F.col("p_type"), F.col("p_name"), "ring|bolt", "widget", ("ECONOMY", "SMALL"), ("PROMO",))
    return read(spark, sf_dir, "part").select("p_partkey", shape.alias("shape"), L.of_kind(F.col("p_type"), F.col("p_name"), "STANDARD", "red|steel", shape == "Linear").alias("kind"))
