"""A taxonomy over the texts of the tables, and the open categories of a key over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import categories, tagging
from panelwright.plans.registry import query
from panelwright.sources.tables import read



def whole(words: str) -> str:
    """Any of words between characters that are neither letters nor digits; \\b differs between engines beside accents."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


#: A taxonomy of what the tables' texts have.
KINDS = tagging.Taxonomy(
    rows=(
        ("tone", "shouting", r"(?-i:[A-Z]{4,}!!)"),
        ("tone", "abuse", whole("idiots?|clowns?|worthless|stupid")),
        ("layout", "table", r"\|.*\|"),
        ("layout", "symbols", r"[#$%&*]{3}"),
        ("legal", "licence", whole("licen[sc]es?")),
        ("legal", "copyright", whole("copyright|all rights reserved")),
        ("contact", "mail", r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]+"),
        ("contact", "address", whole(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")),
        ("contact", "telephone", whole("[0-9]{3}[ .-][0-9]{3,4}[ .-][0-9]{2,4}")),
        ("function words", "english", whole("the|and|with") + ".*" + whole("the|and|of|that")),
        ("function words", "german", whole("der|die|das|und") + ".*" + whole("der|die|das|und|nicht")),
        ("function words", "french", whole("le|les|une|dans") + ".*" + whole("le|les|est|que|qui")),
    ),
    authorities=(("colon", r":\s"), ("quote", r"\"")),
    done=whole("to|the|en|le"),
    blocked=whole("not|no|nicht|pas"),
    not_blocked=whole(r"not\s+the"),
)


def _tag_sql(table: str, keys: str) -> str:
    text = lambda p: p.replace("'", "''")
    match = lambda p: f"regexp_matches(s, '(?i){text(p)}')"
    chain = lambda rows: "CASE " + " ".join(f"WHEN {match(p)} THEN '{n}'" for n, p in rows) + " END"
    hits = ", ".join(f"CASE WHEN {' OR '.join(match(p) for _, p in KINDS.patterns(c))} THEN '{c}' END" for c in KINDS.categories())
    subtype = "CASE category " + " ".join(f"WHEN '{c}' THEN {chain(KINDS.patterns(c))}" for c in KINDS.categories()) + " END"
    marked = f"regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\\b(stage|phase)\\s+-\\s+', '\\1-', 'g'), '([.!?;])\\s+', '\\1' || chr(10), 'g')"
    return f"""WITH p AS (SELECT {keys}, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM (SELECT {keys}, [trim(x) FOR x IN string_split({marked}, chr(10)) IF length(trim(x)) > 3] AS l FROM {table})),
    h AS (SELECT *, unnest([x FOR x IN [{hits}] IF x IS NOT NULL]) AS category FROM p),
    t AS (SELECT *, {subtype} AS subtype, {chain(KINDS.authorities)} AS authority, {match(KINDS.done)} AND NOT regexp_matches(regexp_replace(s, '(?i){KINDS.not_blocked}', ' ', 'g'), '(?i){KINDS.blocked}') AS resolved FROM h)
    SELECT {keys}, category, arg_min(coalesce(subtype, '-'), length(s) * 1000000 + place) AS subtype, arg_min(coalesce(authority, '-'), length(s) * 1000000 + place) AS authority, arg_min(length(s), length(s) * 1000000 + place) AS chars, count(*) AS n, bool_and(resolved) AS resolved FROM t GROUP BY ALL"""


def _tagged(spark, sf_dir, table, keys):
    found = tagging.tag_texts(read(spark, sf_dir, table), keys, "text", KINDS)
    filled = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return found.select(*keys, "category", filled("subtype"), filled("authority"), F.length("sentence").cast("long").alias("chars"), "n", "resolved")


@query("text_tag_documents", _tag_sql("documents", "doc_id"))
def text_tag_documents(spark, sf_dir):
    """Each document's categories by sentence: subtype, authority and whether all sentences of the category are resolved."""
    return _tagged(spark, sf_dir, "documents", ["doc_id"])


@query("text_tag_turns", _tag_sql("conversations", "conv_id, turn"))
def text_tag_turns(spark, sf_dir):
    return _tagged(spark, sf_dir, "conversations", ["conv_id", "turn"])


_CATS, _LAST, _AGE = ("error", "signup", "purchase"), 4, 3
_OPEN_SQL = f"""WITH e AS (SELECT user_id AS k, CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 2 AS INTEGER) AS t, event_type AS c, value FROM events),
  d AS (SELECT k, t, count(*) AS rows FROM e GROUP BY ALL), m AS (SELECT k, t, c, bool_or(value > 100) AS done FROM e WHERE c IN ('error', 'signup', 'purchase') AND value > 40 GROUP BY ALL),
  o AS (SELECT DISTINCT k, t FROM e WHERE value > 15), n AS (SELECT d.k, d.t, o.k IS NOT NULL AS seen FROM d LEFT JOIN o USING (k, t)),
  q AS (SELECT k, t, count(*) FILTER (WHERE seen) OVER (PARTITION BY k ORDER BY t) AS qn FROM n)
  SELECT q.k, q.t, q.qn AS n_observed, """ + ", ".join(
    f"coalesce({c}_qn >= q.qn - {_LAST - 1} AND NOT {c}_done AND q.t - {c}_t < {_AGE}, false) AS open_{c}, {c}_t IS NOT NULL AS ever_{c}, CAST(q.t - {c}_first AS INTEGER) AS since_{c}" for c in _CATS
) + ", " + " + ".join(f"CAST(coalesce({c}_qn >= q.qn - {_LAST - 1} AND NOT {c}_done AND q.t - {c}_t < {_AGE}, false) AS INTEGER)" for c in _CATS) + " AS open_total FROM q " + " ".join(
    f"""LEFT JOIN (SELECT k, t, max(mt) AS {c}_t, min(mt) AS {c}_first, arg_max(qn, mt) AS {c}_qn, arg_max(done, mt) AS {c}_done FROM (SELECT a.k, a.t, m.t AS mt, m.done, b.qn FROM q a JOIN m ON m.k = a.k AND m.t <= a.t AND m.c = '{c}' JOIN q b ON b.k = m.k AND b.t = m.t) GROUP BY ALL) USING (k, t)"""
    for c in _CATS
)


@query("panel_categories", _OPEN_SQL)
def panel_categories(spark, sf_dir):
    """Open, ever and time since the first mention of each category of events, for every user and pair of days."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 2).cast("int").alias("t"), F.col("event_type").alias("category"), "value")
    mentions = events.where(F.col("category").isin(*_CATS) & (F.col("value") > 40)).groupBy("k", "t", "category").agg(F.bool_or(F.col("value") > 100).alias("resolved"))
    found = categories.open_block(events.select("k", "t").distinct(), events.where("value > 15").select("k", "t").distinct(), mentions, "k", "t", list(_CATS), _LAST, _AGE)
    return found
