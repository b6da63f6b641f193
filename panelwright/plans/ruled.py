"""The text rules over the texts, pages and names of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import rules as R
from panelwright.plans.registry import query
from panelwright.sources.tables import read

_EDGE = R.EDGE
#: Openings of the tables' texts: a first word and a licence line.
OPENINGS = (r"^[A-Za-z]+\s", r"[^\n]*license[^\n]*")


@query(
    "text_free_documents",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)^[A-Za-z]+\\s', ' ', 'g'), '(?i)[^\\n]*license[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM documents)
    SELECT doc_id, CASE WHEN len([w FOR w IN string_split(b, ' ') IF w <> '']) >= 3 THEN md5(b) END AS free FROM t""",
)
def text_free_documents(spark, sf_dir):
    """What is left of a text without its openings, as a digest; null under three words."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.free_text(F.col("text"), OPENINGS)).alias("free"))


@query(
    "text_reference_numbers",
    """SELECT doc_id, array_to_string(list_distinct_in_order, ';') AS numbers FROM (SELECT doc_id, [x FOR x, i IN l IF list_position(l, x) = i] AS list_distinct_in_order FROM (SELECT doc_id, [upper(regexp_replace(x, '\\s', '', 'g')) FOR x IN regexp_extract_all(coalesce(text, ''), '(?i)[0-9]{2,}\\s*[./-]\\s*[0-9]{2,}(?:[./-][0-9]+)*')] AS l FROM documents)) WHERE len(list_distinct_in_order) > 0""",
)
def text_reference_numbers(spark, sf_dir):
    """Numbers of the form 12-345 or 12.345.6 that a document names, each once."""
    found = R.numbers_of_form(F.col("text"), r"[0-9]{2,}\s*[./-]\s*[0-9]{2,}(?:[./-][0-9]+)*")
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("n")).where("size(n) > 0").select("doc_id", F.array_join("n", ";").alias("numbers"))


@query("text_person_turns", f"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '(?:^|{_EDGE})(?:La|Die|The|In|Et)\\.?\\s+\\p{{Lu}}\\p{{Ll}}+') AS named FROM conversations")
def text_person_turns(spark, sf_dir):
    """Turns where one of some words stands before a capitalised one."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", R.names_a_person(F.col("text"), ("La", "Die", "The", "In", "Et")).alias("named"))


@query(
    "text_interval_sizes",
    """WITH t AS (SELECT page_id, regexp_extract(html, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(?:ha\\s*)?(?:to|-|–)\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS a, regexp_extract(html, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(?:ha\\s*)?(?:to|-|–)\\s*([0-9]+(?:\\.[0-9]+)?)', 2) AS b FROM pages WHERE html IS NOT NULL)
    SELECT page_id, coalesce(TRY_CAST(nullif(a, '') AS DOUBLE), 0) AS lo, coalesce(TRY_CAST(nullif(b, '') AS DOUBLE), 'infinity'::DOUBLE) AS hi FROM t""",
)
def text_interval_sizes(spark, sf_dir):
    """The first span of numbers that a page names."""
    never = ("\\x00",)
    return read(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", R.interval(F.col("html"), never, never).alias("i")).select("page_id", "i.lo", "i.hi")


@query(
    "text_name_keys",
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(upper(p_brand || ' & ' || p_type || '.'), '&', ' AND '), '[.]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM part",
)
def text_name_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", R.name_key(F.concat("p_brand", F.lit(" & "), "p_type", F.lit("."))).alias("key"))


@query(
    "text_completed_labels",
    """WITH l AS (SELECT DISTINCT p_name AS l FROM part), c AS (SELECT p_partkey, left(p_name, greatest(0, CAST(length(p_name) - p_size % 12 AS INTEGER))) AS clip FROM part),
    j AS (SELECT p_partkey, min(l) AS f, count(l) AS n FROM c LEFT JOIN l ON starts_with(l, clip) AND length(clip) >= 4 GROUP BY 1) SELECT p_partkey, clip, CASE WHEN n = 1 THEN f END AS label FROM j JOIN c USING (p_partkey)""",
)
def text_completed_labels(spark, sf_dir):
    """Names clipped by up to eleven characters, completed where only one name begins so; clips that none or several complete are kept."""
    parts = read(spark, sf_dir, "part")
    clips = parts.select("p_partkey", F.substring("p_name", F.lit(1), (F.length("p_name") - F.col("p_size") % 12).cast("int")).alias("clip"))
    return R.completed(parts, clips, "p_name", "clip")


@query(
    "text_last_dates",
    """WITH t AS (SELECT o_orderkey, o_orderdate AS d, max(l_shipdate) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)
    SELECT o_orderkey, CAST(greatest(CASE WHEN s <= TIMESTAMP '1997-06-30' THEN s END, CASE WHEN d <= TIMESTAMP '1997-06-30' THEN d END) AS DATE) AS last FROM t""",
)
def text_last_dates(spark, sf_dir):
    """The last date up to a day in a cell that names the order's and the shipment's in two forms, and one that does not exist."""
    shipped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    cell = F.concat("o_orderpriority", F.lit(" of "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(", "), "o_orderstatus", F.lit(" at "), F.date_format("s", "yyyy-MM-dd"), F.lit("; due 31-02-2020"))
    return read(spark, sf_dir, "orders").join(shipped, "o_orderkey").select("o_orderkey", R.last_date(cell, F.lit("1997-06-30").cast("date")).alias("last"))
