"""Exact duplicates by full content with skew-safe combining (operator 13), on DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest key of a class stays;
null keys lose to all others, and of rows that repeat the largest key one stays.

One slim pass keeps a row's key and sha256. Digests of more than one in HOT rows, so at most HOT of them, are hot. The texts then meet
in three stages, each of which groups by the text itself next to its digest:

* every task first combines the equal texts that it reads, the map side of the aggregation;
* what tasks send is merged by digest, salt and text; the salt of a hot digest is the sending task's number modulo SALTS, others have one salt;
* the salt winners of hot digests, at most HOT * SALTS a text, are merged by digest and text.

A class's marks go back to its rows by digest: the hot ones are broadcast, so no task gets all rows of a large class, and others have at most
one in HOT rows. That needs no text where all rows of a digest have one text, which the second and third stages
have counted; rows of a digest with several texts are joined by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest of more than one in HOT rows is hot; a hot one's rows are dealt over SALTS groups.
HOT, SALTS = 1000, 64
#: Bytes of the sha256 by which rows are grouped.
DIGEST_BYTES = 32
MARKS = ["keep_id", "group_size", "kept"]


def normal(text: Column) -> Column:
    """text with A-Z in lower case, empty for null. Where all characters are ASCII, lower() changes no others."""
    full = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(full) == F.char_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWER))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 (of the normalised text) of every row of docs.

    Other columns of docs are not read. An empty table has no rows. digest_bytes shortens the digest, for tests of collisions.
    """
    texts = docs.select(F.col(key).alias("key"), normal(F.col(text)).alias("text"))
    digest = lambda sha: F.substring(sha, 1, digest_bytes)
    sha = F.unhex(F.sha2("text", 256))
    slim = stored(texts.select("key", sha.alias("sha"), F.monotonically_increasing_id().alias("row"))).withColumn("digest", digest(F.col("sha")))
    groups = stored(slim.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("key", "row"))["row"].alias("keep_row")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(1, total // HOT)

    hot = F.broadcast(groups.where(is_hot).select("digest", F.lit(True).alias("hot")))
    salted = texts.withColumn("digest", digest(sha)).join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("key").alias("keep_id"), F.count("*").alias("size"))
    winners = stored(merged.select("digest", "salt", F.when(F.col("salt").isNotNull(), F.col("text")).alias("text"), "keep_id", "size"))
    combined = winners.where("salt IS NOT NULL").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    classes = winners.where("salt IS NULL").select("digest", "keep_id", "size").unionByName(combined.select("digest", "keep_id", "size"))
    by_digest = classes.groupBy("digest").agg(F.count("*").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("size").alias("group_size"))
    told = stored(by_digest.join(groups, "digest"))

    of = told.where("n_texts = 1").select("digest", "n", "keep_id", "group_size", "keep_row")
    large = slim.join(F.broadcast(of.where(is_hot)), "digest")
    others = slim.join(hot, "digest", "left_anti").join(of.where(~is_hot), "digest")
    out = large.unionByName(others).withColumn("kept", F.col("row") == F.col("keep_row")).select("key", "sha", *MARKS)
    if told.where("n_texts > 1").take(1):
        out = out.unionByName(_by_text(texts.withColumn("sha", sha).withColumn("digest", digest(F.col("sha"))), told.where("n_texts > 1").select("digest")))
    return out.select(F.col("key").alias(key), *MARKS, F.lower(F.hex("sha")).alias("text_sha256"))


def _by_text(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """The marks of rows whose digest stands for several texts, by the texts themselves."""
    rows = stored(texts.join(digests, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    classes = rows.groupBy("digest", "text").agg(F.max(F.struct("key", "row")).alias("w"), F.count("*").alias("group_size"))
    of = classes.select("digest", "text", F.col("w.key").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size")
    return rows.join(of, ["digest", "text"]).select("key", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. A row stays by its key: rows that repeat a key stay or go together, and
    rows without a key stay only if no text of theirs has one."""
    marks = marked(docs, key, text)
    stay = stored(marks.groupBy(key).agg(F.max("kept").alias("stays")).where("stays")).select(F.col(key).alias("_stays"))
    return docs.join(stay, F.col(key).eqNullSafe(F.col("_stays")), "left_semi")
