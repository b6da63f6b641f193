"""Text rules: normalisation, similarity, tagging, mentions and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text as X
from panelwright.operators import windows
from panelwright.plans.registry import query
from panelwright.sources.tables import read

#: A taxonomy of remark categories over the words of the driver's texts.
TAXONOMY = [("shouting", r"[A-Z]{4,}!!"), ("symbols", r"[#$%&*]{3}"), ("licence", r"(?i)license"), ("insult", r"(?i)\b(idiot|clown|worthless)\b"), ("contact", r"[0-9]{3}[.][0-9]{1,3}[.]")]


@query("text_normalise", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ', ' || p_type || ' (' || p_name || ')'), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def text_normalise(spark, sf_dir):
    raw = F.concat("p_brand", F.lit(", "), "p_type", F.lit(" ("), "p_name", F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", X.normalise_name(raw).alias("name"))


@query(
    "text_abbreviations",
    """WITH t AS (SELECT page_id, unnest(string_split_regex(lower(url), '[^a-z0-9]+')) AS t, generate_subscripts(string_split_regex(lower(url), '[^a-z0-9]+'), 1) AS i FROM pages)
    SELECT page_id, string_agg(CASE t WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE t END, ' ' ORDER BY i) AS name FROM t WHERE t NOT IN ('', 'http', 'www') GROUP BY 1""",
)
def text_abbreviations(spark, sf_dir):
    name = X.normalise_name(F.col("url"), {"en": "english", "fr": "french"}, ("http", "www"))
    return read(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query("text_codes", "SELECT c_custkey, 'CU' || lpad(CAST(CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS VARCHAR), 6, '0') AS code, nullif(upper(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')), 'BUILDING') AS seg FROM customer")
def text_codes(spark, sf_dir):
    number = F.regexp_extract("c_name", r"(\d+)", 1).cast("long").cast("string")
    return read(spark, sf_dir, "customer").select("c_custkey", X.padded_code(number, "CU", 6).alias("code"), X.normalise_code(F.col("c_mktsegment"), ("BUILDING",)).alias("seg"))


@query(
    "text_tag",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 'shouting' END, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' END, CASE WHEN regexp_matches(text, '(?i)license') THEN 'licence' END,
      CASE WHEN regexp_matches(text, '(?i)\\b(idiot|clown|worthless)\\b') THEN 'insult' END, CASE WHEN regexp_matches(text, '[0-9]{3}[.][0-9]{1,3}[.]') THEN 'contact' END], lambda x: x IS NOT NULL), ';') AS tags FROM documents""",
)
def text_tag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.tags(F.col("text"), TAXONOMY), ";").alias("tags"))


@query(
    "text_first_match",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN regexp_matches(text, '(?i)license') THEN 'licence' END AS tag FROM documents",
)
def text_first_match(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.first_match(F.col("text"), [TAXONOMY[1], TAXONOMY[2]]).alias("tag"))


@query(
    "text_sentences",
    """WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)))) AS s FROM documents) SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM s WHERE length(s) >= 3 GROUP BY 1""",
)
def text_sentences(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(s).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("text_max_number", "SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(\\d+) ', 1), lambda x: TRY_CAST(x AS DOUBLE))) AS top FROM documents")
def text_max_number(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.max_number(F.col("text"), r"(\d+) ").alias("top"))


@query(
    "text_jaccard",
    """WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS j FROM t a JOIN t b ON b.item_id = a.item_id + 1""",
)
def text_jaccard(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("w").alias("v"))
    return items.join(after, "item_id").select(F.col("item_id").alias("a"), "b", F.round(X.jaccard(F.col("w"), F.col("v")), 9).alias("j"))


@query(
    "text_edit_ratio",
    """SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_type, b.p_type) / greatest(length(a.p_type), length(b.p_type)), 9) AS ratio FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
)
def text_edit_ratio(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), "p_type")
    after = parts.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("p_type").alias("t"))
    return parts.join(after, "a").select("a", "b", F.round(X.edit_ratio(F.col("p_type"), F.col("t")), 9).alias("ratio"))


@query("text_url_domain", "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS domain FROM pages")
def text_url_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.url_domain(F.col("url")).alias("domain"))


@query("text_one_line", "SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[<>[:cntrl:]]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 300) AS line FROM documents")
def text_one_line(spark, sf_dir):
    """A report line of each text; its cut is the feature."""
    return read(spark, sf_dir, "documents").select("doc_id", X.one_line(F.col("text")).alias("line"))


@query(
    "text_snippet",
    "SELECT doc_id, substr(text, greatest(strpos(text, 'icense') - 20, 1), 60) AS snippet FROM documents WHERE strpos(text, 'icense') > 0",
)
def text_snippet(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "icense").alias("snippet")).where("snippet IS NOT NULL")


@query("text_non_latin", "SELECT doc_id, round(len(regexp_extract_all(text, '[^\\x00-\\x{024F}]')) / nullif(len(regexp_extract_all(text, '\\pL')), 0), 9) AS share FROM documents")
def text_non_latin(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(X.non_latin_share(F.col("text")), 9).alias("share"))


@query("text_html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def text_html_title(spark, sf_dir):
    """Labelled fields of a page by patterns."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query(
    "text_distinctive_tokens",
    """WITH t AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM benchmark), d AS (SELECT token, count(*) AS df FROM t GROUP BY 1 HAVING count(*) <= 2)
    SELECT item_id, count(*) AS tokens FROM t JOIN d USING (token) GROUP BY 1""",
)
def text_distinctive_tokens(spark, sf_dir):
    tokens = read(spark, sf_dir, "benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    rare = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df <= 2")
    return tokens.join(rare, "token").groupBy("item_id").agg(F.count("*").alias("tokens"))


@query(
    "text_numbers_check",
    """WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS n FROM conversations) SELECT conv_id, turn, len(n) AS numbers, len(list_filter(n, lambda x: NOT (abs(turn - x) <= 0.5))) AS unsupported FROM t""",
)
def text_numbers_check(spark, sf_dir):
    """Numbers of a turn's text that no known fact (here: the turn) supports."""
    turns = read(spark, sf_dir, "conversations")
    facts = F.array(F.col("turn").cast("double"))
    return turns.select("conv_id", "turn", F.size(X.numbers(F.col("text"))).cast("long").alias("numbers"), F.size(X.unsupported_numbers(F.col("text"), facts)).cast("long").alias("unsupported"))


@query(
    "text_mention_events",
    """WITH d AS (SELECT doc_id, source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, regexp_matches(text, '[#$%&*]{3}') AS hit FROM documents),
    m AS (SELECT *, seq - lag(seq) OVER (PARTITION BY k ORDER BY seq) AS gap FROM d WHERE hit), i AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY seq) AS event FROM m),
    l AS (SELECT k, max(seq) AS last FROM d GROUP BY k)
    SELECT i.k, CAST(event AS BIGINT) AS event, count(*) AS mentions, min(doc_id) AS first_seen, max(doc_id) AS last_seen, max(i.seq) >= any_value(l.last) - 1 AS open FROM i JOIN l ON l.k = i.k GROUP BY i.k, event""",
)
def text_mention_events(spark, sf_dir):
    """Runs of consecutive reports that mention a category; an event is open if seen in the last two."""
    w = windows.ordered(["k"], "doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("k"), F.col("text").rlike(TAXONOMY[1][1]).alias("hit")).withColumn("seq", F.row_number().over(w))
    last = docs.groupBy("k").agg(F.max("seq").alias("last"))
    hits = docs.where("hit")
    breaks = ~F.coalesce(F.col("seq") - F.lag("seq").over(windows.ordered(["k"], "seq")) == 1, F.lit(False))
    events = windows.islands(hits, ["k"], "seq", breaks, "event").groupBy("k", "event").agg(F.count("*").alias("mentions"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"), F.max("seq").alias("seq"))
    return events.join(last, "k").select("k", "event", "mentions", "first_seen", "last_seen", (F.col("seq") >= F.col("last") - 1).alias("open"))
