"""Document fingerprints: threshold-scaled sketches of word shingles (operator 1), on DataFrame functions only.

A shingle is five words in a row, A-Z lowered; a text with fewer words is one shingle. Each has the first 32
bits of its md5, as 8 hexadecimal digits, and a fingerprint is the sorted run of those digits below a fixed
fraction of their range, with the smallest of all, so that a text with words never has an empty one. As the threshold
is the same for every text, fingerprints of texts of any size compare directly, and two merge by union:
``likeness`` estimates the Jaccard likeness of the shingle sets, ``containment`` the share of one in the other.

Null is as empty: no shingles, an empty fingerprint. Two empty fingerprints are alike (1), an empty one and another are
not (0).

``with_next`` pairs every document with the one that follows it by descending key, the last with the first. Documents
shuffle once, by blocks of BLOCK keys, each at most BLOCK rows for unique keys; a block's last document finds its
successor through a copy of the next block's first one. The order of blocks comes from range partitions of
one slim row a block. Rows of one key follow each other in the order of their texts; null keys come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, let, words
from panelwright.llm.ordered import successors

WORDS = 5
DIGITS = 8
#: Share of the shingle hashes that a sketch retains.
FRACTION = 0.25
BLOCK = 256
#: Blocks up to which their successors, 16 bytes each, are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_BLOCKS = 500_000


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """The sorted retained hashes of the text's shingles, array<string>."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    below = F.lit(f"{min(int(fraction * 16**DIGITS), 16**DIGITS - 1):0{DIGITS}x}")
    digits = lambda shingle: F.substring(F.md5(F.array_join(shingle, " ")), 1, DIGITS)

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: digits(F.slice(w, i, WORDS)))).otherwise(F.array().cast("array<string>"))

    retained = lambda h: let(F.array_min(h), lambda least: F.filter(h, lambda x: (x < below) | (x == least)))
    return F.array_sort(F.array_distinct(let(let(words(lower), hashes), retained)))


def fingerprint(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sketches, 0 to 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n).cast("double"))
    )


def containment(a: Column, b: Column) -> Column:
    """Share of sketch a found in sketch b; 1 where a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two texts' shingles together."""
    below = F.lit(f"{min(int(fraction * 16**DIGITS), 16**DIGITS - 1):0{DIGITS}x}")
    return let(F.array_union(a, b), lambda h: let(F.array_min(h), lambda least: F.array_sort(F.filter(h, lambda x: (x < below) | (x == least)))))


def with_next(df: DataFrame, key: str, text: str, derived: dict[str, Column]) -> DataFrame:
    """df's key and text with the derived columns, and ``next``: text and derived columns of the document that follows.

    Derived columns are computed behind the shuffle, so that only texts are dealt, once for a row and once for a block's
    copied successor.
    """
    block = F.shiftright(F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long")), BLOCK.bit_length() - 1)
    df = df.select(key, text)
    tops = df.select(block.alias("_block"), F.col(key).alias("_top")).groupBy("_block").agg(F.max("_top").alias("_top"))
    chain = cut(successors(tops, F.col("_block").desc()).select("_block", F.col("next._top").alias("_top")))
    if chain.count() <= BROADCAST_BLOCKS:
        chain = F.broadcast(chain)
    first = F.row_number().over(Window.partitionBy("_block").orderBy(text))
    copies = df.join(chain, F.col(key).eqNullSafe(F.col("_top"))).withColumn("_n", first).where("_n = 1").drop("_n", "_top")
    both = df.withColumn("_block", block).withColumn("_own", F.lit(True)).unionByName(copies.withColumn("_own", F.lit(False)))
    order = Window.partitionBy("_block").orderBy(F.col("_own").desc(), F.col(key).desc_nulls_last(), text)
    following = F.lead(F.struct(text, *derived)).over(order)
    dealt = both.repartition("_block").withColumns(derived)
    return dealt.withColumn("next", following).where("_own").drop("_block", "_own")


def compare_with_edit(docs: DataFrame, key: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is replaced by the start of the next text."""
    full = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    paired = with_next(full, key, "_text", {"_sketch": sketch(F.col("_text"), fraction)})
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.col("next._text"), F.lit(1), third))
    made = paired.select(key, n.cast("long").alias("n_chars"), "_sketch", F.col("next._sketch").alias("_next"), edited.alias("_edited"))
    made = made.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("_edit", sketch(F.col("_edited"), fraction)).drop("_edited")
    return made.select(
        key,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("_sketch")).alias("fingerprint"),
        fingerprint(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edit")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next")).alias("near_next"),
    )
