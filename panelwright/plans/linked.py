"""Texts linked to entities, search strings of entities, and texts classified with a severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.rules import EDGE
from panelwright.operators import linking
from panelwright.plans.registry import query
from panelwright.sources.tables import read

RULES = linking.Rules(most_df=8, code=r"([0-9]{2,4})", objects=("that", "then", "with", "here"), generic=("that",), dropped=("thou",))
NOISE = r"[0-9][0-9.,/]*|[.,!?]"
CATEGORIES = [("court", r"(?i)the\s+[a-z]*th"), ("land", r"(?i)(?:de|les)\s+e[a-z]+"), ("money", r"[0-9]+")]
SEVERE, NEGATIVE = r"[A-Z]{4,}", r"(?i)[a-z]*ation"


def _entities(spark, sf_dir):
    """Benchmark items as entities: their text, and its first word where it is short; no state."""
    short = F.nullif(F.regexp_extract("text", "^([A-Za-z]{2,8}) ", 1), F.lit(""))
    state = F.nullif(F.regexp_extract("text", "([A-Za-z]{4,})[.]$", 1), F.lit(""))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("name"), short.alias("short"), state.alias("state"))
    return linking.profiles(items, "item_id", "name", "state", "short", RULES)


def _named_sql(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(?i)(?:^|{EDGE}){word}s?(?:{EDGE}|$)')"


_FIRST = "CASE " + " ".join(f"WHEN {_named_sql('name', o)} THEN '{o}'" for o in RULES.objects) + " END"
_ENTITIES = rf"""b AS (SELECT item_id AS entity, coalesce(text, '') AS name, nullif(regexp_extract(text, '^([A-Za-z]{{2,8}}) ', 1), '') AS short, nullif(regexp_extract(text, '([A-Za-z]{{4,}})[.]$', 1), '') AS state FROM benchmark),
    w AS (SELECT entity, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z]{{4,}}'))) AS word FROM b), r AS (SELECT word FROM w GROUP BY 1 HAVING count(*) <= {RULES.most_df}),
    p AS (SELECT w.entity, word FROM w JOIN r USING (word) JOIN b ON b.entity = w.entity WHERE word <> 'thou' AND NOT list_contains(regexp_extract_all(lower(coalesce(state, '')), '[a-z]{{4,}}'), word)),
    e AS (SELECT entity, name, short, state, regexp_extract_all(name, '([0-9]{{2,4}})', 1) AS codes, {_FIRST} AS object FROM b)"""


@query(
    "text_links",
    rf"""WITH {_ENTITIES}, d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), tw AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(t), '[a-z]{{4,}}'))) AS word FROM d),
    s AS (SELECT doc_id, entity, count(*) AS shared FROM tw JOIN p USING (word) GROUP BY 1, 2),
    c AS (SELECT doc_id, entity, least(1.0, shared / 2) / 2 + CASE WHEN list_has_any(codes, regexp_extract_all(t, '([0-9]{{2,4}})', 1)) OR list_contains(string_split_regex(t, '[^A-Za-z0-9_]+'), short)
        OR (object = 'then' AND {_named_sql('t', 'then')}) OR (object = 'with' AND {_named_sql('t', 'with')}) OR (object = 'here' AND {_named_sql('t', 'here')}) THEN 0.5 ELSE 0 END AS score FROM s JOIN e USING (entity) JOIN d USING (doc_id)),
    k AS (SELECT *, lead(score) OVER o AS second, row_number() OVER o AS n FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, entity DESC)),
    x AS (SELECT *, CASE WHEN score < 0.5 THEN 'none' WHEN second >= score - 0.1 THEN 'ambiguous' ELSE 'linked' END AS outcome FROM k WHERE n = 1)
    SELECT doc_id, CASE WHEN outcome = 'linked' THEN entity END AS entity, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(outcome, 'none') AS outcome FROM d LEFT JOIN x USING (doc_id)""",
)
def text_links(spark, sf_dir):
    """The item that a document is about, by distinctive words and an anchor; ambiguous where another is as near."""
    return linking.link(read(spark, sf_dir, "documents"), "doc_id", "text", _entities(spark, sf_dir), RULES)


@query(
    "text_search_aliases",
    rf"""WITH {_ENTITIES}, o AS (SELECT e.*, [x FOR x, i IN l IF list_position(l, x) = i AND list_contains(g, x)] AS places FROM (SELECT e.*, regexp_extract_all(lower(name), '[a-z]{{4,}}') AS l, coalesce(g, []) AS g FROM e LEFT JOIN (SELECT entity, list(word) AS g FROM p GROUP BY 1) USING (entity)) e),
    f AS (SELECT *, [upper(x[1]) || x[2:] FOR x IN places[1:3]] AS t, list_filter(string_split_regex(regexp_replace(name, '{NOISE}', ' ', 'g'), '\s+'), lambda x: x <> '') AS c FROM o),
    q AS (SELECT *, CASE WHEN len(places) > 0 THEN list_filter([CASE WHEN object IS NOT NULL THEN array_to_string(t[1:2], ' ') || ' ' || object END, CASE WHEN state IS NOT NULL AND len(places) > 1 THEN array_to_string(t, ' ') || ' ' || state END, CASE WHEN len(codes) > 0 THEN codes[1] || ' ' || t[1] END,
        CASE WHEN short IS NOT NULL THEN concat_ws(' ', short, array_to_string(t[1:2], ' '), CASE WHEN object <> 'that' THEN object END) END, CASE WHEN len(places) > 2 THEN concat_ws(' ', t[1], t[3], object) END], lambda x: x IS NOT NULL) ELSE [] END AS a FROM f),
    u AS (SELECT entity, [x FOR x, i IN a IF list_position(a, x) = i] AS m, [array_to_string(c[1:6], ' '), trim(concat_ws(' ', array_to_string(c[1:4], ' '), state))] AS plain FROM q),
    v AS (SELECT entity, CASE WHEN len(m) < 3 THEN list_concat(m, plain) ELSE m END AS z FROM u)
    SELECT entity, array_to_string(([x FOR x, i IN z IF list_position(z, x) = i AND length(x) > 3])[1:5], ';') AS aliases FROM v""",
)
def text_search_aliases(spark, sf_dir):
    """Up to five search strings of each item: its places with a second anchor, or else the beginning of its name."""
    return _entities(spark, sf_dir).select("entity", F.array_join(linking.aliases(RULES.generic, ("All",), NOISE), ";").alias("aliases"))


@query(
    "text_severities",
    "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{c}'" for c, p in CATEGORIES)
    + f" END AS category, CASE WHEN regexp_matches(coalesce(text, ''), '{SEVERE}') THEN 3 WHEN regexp_matches(coalesce(text, ''), '{NEGATIVE}') THEN 2 ELSE 1 END AS severity FROM conversations",
)
def text_severities(spark, sf_dir):
    """The first category of each turn and its severity."""
    told = linking.classified(F.col("text"), CATEGORIES, SEVERE, NEGATIVE)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", told.alias("c")).select("conv_id", "turn", "c.category", "c.severity")
