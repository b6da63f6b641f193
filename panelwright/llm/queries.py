"""The operators as named queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import attribution, bpe, cotraining, elkan, exact_dedup, fingerprint, html_text, jaccard_join, language, mixing, norm_search, quality_rules, secret_scan
from panelwright.llm.common import cut, table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit, and how near the edit and the next text are."""
    return fingerprint.compare_with_edit(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (
  SELECT doc_id, n, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS following, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), f AS (SELECT *, substr(text, 1, n - n // 3) || substr(following, 1, n // 3) AS edited FROM e),
w AS (
  SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a,
    regexp_extract_all(translate(edited, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS b FROM f
), h AS (
  SELECT *, CASE WHEN len(a) = 0 THEN [] ELSE list_sort(list_distinct([substr(md5(array_to_string(a[i:i + 4], ' ')), 1, 8) for i in range(1, greatest(len(a) - 3, 2))])) END AS x,
    CASE WHEN len(b) = 0 THEN [] ELSE list_sort(list_distinct([substr(md5(array_to_string(b[i:i + 4], ' ')), 1, 8) for i in range(1, greatest(len(b) - 3, 2))])) END AS y FROM w
), s AS (
  SELECT doc_id, next_id, n, edited, [v for v in x if v < '40000000' OR v = x[1]] AS x, [v for v in y if v < '40000000' OR v = y[1]] AS y FROM h
), t AS (
  SELECT s.*, z.x AS z, len(list_intersect(s.x, s.y)) AS near_y, len(list_intersect(s.x, z.x)) AS near_z FROM s JOIN s AS z ON s.next_id = z.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(x, ''), '') AS fingerprint,
  coalesce(array_to_string(y, ''), '') AS edited_fingerprint,
  CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE CAST(near_y AS DOUBLE) / (len(x) + len(y) - near_y) END AS near_edited,
  CASE WHEN len(x) + len(z) = 0 THEN 1.0 ELSE CAST(near_z AS DOUBLE) / (len(x) + len(z) - near_z) END AS near_next
FROM t
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that each document is good, by both views and combined, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    every = cotraining.features(docs)
    return cotraining.score_features(every, cotraining.train_on(every, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every text, by rules learned from the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    judged = quality_rules.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: the patterns' and the Markov models'. Null is as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    models = secret_scan.train(secret_scan.default_samples(docs))
    found = docs.select("doc_id", secret_scan.scan(F.col("text"), models).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(F.filter("found", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
    )


MIX = {"weights": [5, 2, 1], "share": 1.5, "max_epochs": 2.0}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix, its source's size and target."""
    slim = cut(mixing.slim_rows(table(spark, sf_dir, "documents")))
    mixed = mixing.repeat(slim, mixing.plan(slim, **MIX), MIX["max_epochs"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('5:' || CAST(doc_id AS VARCHAR)), 1, 5)) AS BIGINT) AS draw
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
g AS (
  SELECT *, row_number() OVER o AS j,
    CAST((SELECT 1.5 * sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source)
), l AS (SELECT arg_min(level, j) AS level FROM g WHERE cap >= level * weight),
t AS (
  SELECT source, source_size, CAST(least(cap, (SELECT level FROM l) * weight) AS DOUBLE) AS target FROM g
), r AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM t),
c AS (
  SELECT source, draw, n, sum(n) OVER (PARTITION BY source ORDER BY draw) AS upto
  FROM (SELECT source, draw, sum(size) AS n FROM d GROUP BY source, draw)
), m AS (
  SELECT c.source, max(c.draw) AS last FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
  WHERE c.upto - c.n / 2 <= r.target - r.whole * r.source_size GROUP BY c.source
)
SELECT d.doc_id, d.size, r.source_size, r.target, d.size * least(2, r.whole + CAST(d.draw <= coalesce(m.last, -1) AS BIGINT)) AS taken,
  least(2, r.whole + CAST(d.draw <= coalesce(m.last, -1) AS BIGINT)) AS repeats
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents whose crc32 is no multiple of 5."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    prototypes = language.train(docs.where(fold != 0).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), language.predict(F.col("text"), prototypes).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under the multilingual byte-level vocabulary, and the bytes they decode to.

    The digests are of the operator's outputs: the ids, and what decoding gives. Null is as empty.
    """
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.coded(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text; a token that crosses lines belongs to the line of its first character.

    One row for each line: its place, its code points with the newline, its tokens, and the
    document's tokens and boundary-crossing tokens. A null or empty text has one row, without a line.
    """
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = attribution.by_section(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, "first")
    return (
        counted.select("doc_id", "tokens.n_tokens", "tokens.n_crossing", F.posexplode_outer(F.arrays_zip(F.col("section_sizes").alias("size"), F.col("tokens.counts").alias("n"))).alias("section", "line"))
        .select("doc_id", F.col("section").cast("long").alias("section"), F.col("line.size").alias("section_chars"), F.col("line.n").cast("long").alias("section_tokens"), F.col("n_tokens").alias("doc_tokens"), F.col("n_crossing").alias("crossing_tokens"))
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), h AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] ELSE list_distinct([array_to_string(a[i:i + 4], ' ') for i in range(1, greatest(len(a) - 3, 2))]) END AS s FROM w
), g AS (SELECT s, min(doc_id) AS rep, len(s) AS m FROM (SELECT doc_id, list_sort(s) AS s FROM h) GROUP BY s),
x AS (SELECT rep, m, unnest(s) AS shingle FROM g),
p AS (
  SELECT a.rep AS u, b.rep AS v FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.rep < b.rep AND 5 * least(a.m, b.m) >= 4 * greatest(a.m, b.m)
  GROUP BY a.rep, b.rep, a.m, b.m HAVING 100 * count(*) >= 80 * (a.m + b.m - count(*))
), e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT rep AS u, rep AS root FROM g UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u WHERE r.root < e.v),
c AS (SELECT u, min(root) AS root FROM r GROUP BY u)
SELECT h.doc_id, CAST(len(h.s) AS BIGINT) AS n_shingles, CASE WHEN len(h.s) = 0 THEN h.doc_id ELSE c.root END AS component_id
FROM h JOIN g ON list_sort(h.s) = g.s JOIN c ON c.u = g.rep
"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its code points; a null page's text is empty."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the anchors, ids divisible by 100, and their five best rows of equal label: the ten best rows of other labels in the window."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return norm_search.hard_negatives(rows, "vec_id", "embedding", label, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.r AS anchor, a.id AS anchor_id, b.r, b.id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.id % 100 = 0
), p AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, r) AS place FROM s WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.id NULLS LAST, s.r) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after five rounds of 40 centroids, exact distances and their sums."""
    return elkan.with_inertia(*elkan.cluster(table(spark, sf_dir, "embeddings")))


def _op12_sql() -> str:
    """The rounds spelled out: a<i> has each vector's centroid in round i, c<i> the centroids before it."""
    nearest = """a{i} AS (
  SELECT v.r, arg_min(c.n, v.q + list_inner_product(c.p, c.p) - 2 * list_inner_product(v.e, c.p) + c.n / 1024) AS n,
    CAST(min(v.q + list_inner_product(c.p, c.p) - 2 * list_inner_product(v.e, c.p)) AS BIGINT) AS distance
  FROM v CROSS JOIN c{i} AS c GROUP BY v.r
)"""
    moved = """m{i} AS (
  SELECT n, list(CAST(floor(total / size) AS DOUBLE) ORDER BY place) AS p
  FROM (SELECT a.n, g.place, sum(v.e[g.place]) AS total, count(*) AS size FROM a{i} AS a JOIN v ON v.r = a.r CROSS JOIN generate_series(1, 64) AS g(place) GROUP BY a.n, g.place) GROUP BY n
), c{j} AS (SELECT c.n, coalesce(m.p, c.p) AS p FROM c{i} AS c LEFT JOIN m{i} AS m ON m.n = c.n)"""
    rounds = ",\n".join(f"{nearest.format(i=i)},\n{moved.format(i=i, j=i + 1)}" for i in range(5))
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), v AS MATERIALIZED (SELECT *, list_inner_product(e, e) AS q FROM w),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS n, e AS p FROM v QUALIFY n < 40),
{rounds},
{nearest.format(i=5)}
SELECT v.vec_id, CAST(a.n AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c.p], ',')) AS centroid_sha256
FROM a5 AS a JOIN v ON v.r = a.r JOIN c5 AS c ON c.n = a.n
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts: the row that stays, its size and its digest."""
    return exact_dedup.marked(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_bpe": op7_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_join": op9_ngram_join,
    "op10_html_text": op10_html_text,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroids": op12_centroids,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_fingerprint": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op9_ngram_join": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_centroids": _op12_sql(),
    "op13_exact_dedup": OP13_SQL,
}
