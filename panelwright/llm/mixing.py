"""Mixing sources to target weights by capped water-filling (operator 5).

Sources share a budget of words by weight. A source's target stops at ``max_epochs`` times its size; what it
cannot take is shared again, by weight, among the others, until none is above its cap. Then every
document is repeated ``floor(target / size)`` times, and once more in a seeded random order of the
source's documents until the rest of the target is used up, so a source's words miss its target by about
half a document.

Documents are reduced to one slim row each, written once; the level is found by rounds of sums over one row a
source. The random order is 20 bits of a seeded hash of the id: the place where the rest is used up is
found from sums by the upper 10 bits and then, within one bucket, by the lower 10. So no source, however
large, is sorted or gathered: a task sees at most 1024 sums of a source. Documents of equal 20 bits are taken together.

A null source is a source, the last. Null and empty texts have no words: their repeats follow their source's
and take nothing. A source without words has target 0. Repeated ids are repeated alike. An empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import SPACE, cut
from panelwright.llm.ordered import numbered

#: Sources up to which the plan, about 100 bytes a source, is broadcast; beyond, Spark joins as it sees fit.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """20 random bits of the key under the seed, the same in any run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 5), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A text that tells null from every source, null last in order."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources (source_size, weight) with ``target``; each round is one sum over the sources."""
    cap = F.lit(max_epochs) * F.col("source_size")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weights:
        return sources.withColumn("target", F.lit(0.0))
    level, clamped = share * total / weights, 0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        n, used, rest = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not rest:
            break
        clamped, level = n, (share * total - used) / rest
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))


def plan(slim: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source: its key, size, target, whole repeats and the highest draw that is repeated once more.

    slim has ``source_key``, ``size`` and ``draw``. Weights go to the sources in order of key, repeating.
    """
    sizes = numbered(slim.groupBy("source_key").agg(F.sum("size").alias("source_size")), "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = water_fill(cut(sizes.select("source_key", "source_size", weight.alias("weight"))), share, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    by_upper = slim.groupBy("source_key", F.shiftright("draw", 10).alias("upper")).agg(F.sum("size").alias("n"))
    ordered = Window.partitionBy("source_key").orderBy("upper")
    reached = by_upper.withColumn("upto", F.sum("n").over(ordered)).join(sources.select("source_key", "rest"), "source_key").where(F.col("upto") > F.col("rest"))
    edge = reached.groupBy("source_key").agg(F.min_by(F.struct("upper", (F.col("upto") - F.col("n")).alias("before"), "rest"), "upper").alias("e")).select("source_key", "e.*")
    edge = _small(cut(edge))
    inside = slim.withColumn("upper", F.shiftright("draw", 10)).join(edge, ["source_key", "upper"])
    by_draw = inside.groupBy("source_key", "draw", "before", "rest").agg(F.sum("size").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source_key").orderBy("draw"))
    taken = by_draw.withColumn("upto", upto).where(F.col("upto") - F.col("n") / 2 <= F.col("rest")).groupBy("source_key").agg(F.max("draw").alias("last"))
    below = edge.select("source_key", (F.col("upper") * 1024 - 1).alias("below"))
    out = sources.join(below, "source_key", "left").join(taken, "source_key", "left")
    # Without an edge nothing exceeds the rest, which is so only if the source has no words.
    return cut(out.select("source_key", "source_size", "target", "whole", F.coalesce("last", "below", F.lit(1 << 20)).alias("last")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def slim_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 5) -> DataFrame:
    """key, source_key, size and draw of every document."""
    return docs.select(F.col(key), source_key(F.col(source)).alias("source_key"), word_count(F.col(text)).alias("size"), draw(F.col(key), seed).alias("draw"))


def repeat(rows: DataFrame, sources: DataFrame, max_epochs: float = 2.0) -> DataFrame:
    """rows (source_key, draw and more) with source_size, target and repeats. Of a fractional max_epochs, targets use all, but no document is repeated more often than its whole part."""
    repeats = F.least(F.col("whole") + (F.col("draw") <= F.col("last")).cast("long"), F.lit(int(max_epochs)).cast("long"))
    return rows.join(_small(sources), "source_key").withColumn("repeats", repeats).drop("whole", "last")


def apply(docs: DataFrame, sources: DataFrame, max_epochs: float = 2.0, key: str = "doc_id", source: str = "source", seed: int = 5) -> DataFrame:
    """docs, each row as often as it is repeated."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), source_key(F.col(source)).alias("source_key"), draw(F.col(key), seed).alias("draw"))
    copies = F.sequence(F.lit(1).cast("long"), F.col("repeats"))
    return repeat(rows, sources, max_epochs).where("repeats > 0").withColumn("_copy", F.explode(copies)).select("_row.*")
