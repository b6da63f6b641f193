"""Resamples of whole clusters with Poisson weights: intervals of average precision and of matched differences.

A cluster's weight in a resample is read from a hash of its key, the resample and a seed, so reruns agree however rows are dealt and SQL can draw the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.scratch import stored
from panelwright.sources.session import shared_folder, ship

#: Chance of a Poisson(1) weight of at most 0, 1, ..., 6; weights above 7 (1 in 100,000) count as 7.
REACHES = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def uniform(*parts) -> Column:
    """A number from 0 to 1 from the md5 of the parts joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def poisson(u: Column) -> Column:
    return sum(((u >= reach).cast("int") for reach in REACHES), F.lit(0))


def weights(cluster: str, n_boot: int, seed: int = 0) -> Column:
    """The weights of a cluster in each resample, an array of ints."""
    # Two steps: poisson() compares its number seven times.
    numbers = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: uniform(F.col(cluster).cast("string"), b.cast("string"), F.lit(str(seed))))
    return F.transform(numbers, poisson)


def draws(df: DataFrame, cluster: str, n_boot: int, seed: int = 0) -> DataFrame:
    """The clusters of df with _w, their weights; written once. Dealt by number, as few bytes of clusters make much work."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clusters = df.select(cluster).where(F.col(cluster).isNotNull()).distinct().repartition(parts, F.xxhash64(cluster))
    return stored(clusters.withColumn("_w", weights(cluster, n_boot, seed).cast("array<tinyint>")))


def drawn(df: DataFrame, cluster: str, n_boot: int, seed: int = 0) -> DataFrame:
    """df with _w, the weights of its cluster, drawn once for each cluster."""
    return df.join(draws(df, cluster, n_boot, seed), cluster)


def uniform_sql(cluster: str, b: str = "b", seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5({cluster} || ':' || {b} || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"CAST({u} >= {r!r} AS INTEGER)" for r in REACHES) + ")"


def _lists(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _array(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


#: Most ranges of scores, as each task gets the sums before each of them.
RANGES = 256
STEPS = "fold string, score double, wide boolean, n binary, pos binary"
#: Stands for weights of positives that equal those of all rows; empty for none.
SAME = b"="


def _packed(n: np.ndarray, pos: np.ndarray) -> list[pa.Array]:
    """Weights as bytes, one each where they fit: most scores are of one row, which is then not eight times as long."""
    wide, some, same = n.max(1) > 127, pos.any(1), (pos == n).all(1)
    packed = lambda row, w: (row if w else row.astype(np.int8)).tobytes()
    found = [SAME if same[i] and some[i] else packed(pos[i], wide[i]) if some[i] else b"" for i in range(len(pos))]
    return [pa.array(wide), pa.array([packed(row, w) for row, w in zip(n, wide)], pa.binary()), pa.array(found, pa.binary())]


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The weights of rows and of positives that _packed() made."""
    wide, packed, found = batch.column("wide").to_numpy(zero_copy_only=False), batch.column("n").to_pylist(), batch.column("pos").to_pylist()
    n = np.zeros((len(packed), len(packed[0]) // (8 if wide[0] else 1)), np.int64)
    pos = np.zeros_like(n)
    same = np.array([x == SAME for x in found])
    own = np.array([len(x) > 0 for x in found]) & ~same
    for rows, kind in ((~wide, np.int8), (wide, np.int64)):
        n[rows] = np.frombuffer(b"".join([packed[i] for i in np.flatnonzero(rows)]), kind).reshape(-1, n.shape[1])
        pos[rows & own] = np.frombuffer(b"".join([found[i] for i in np.flatnonzero(rows & own)]), kind).reshape(-1, n.shape[1])
    pos[same] = n[same]
    return n, pos


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of the rows and of the positives of each fold and score of a batch, summed."""
    for batch in batches:
        if batch.num_rows:
            fold, score = np.array(batch.column("fold").to_pylist()), batch.column("score").to_numpy()
            w, y = _lists(batch.column("w")), batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((score, fold))
            starts = np.flatnonzero(np.r_[True, (fold[order][1:] != fold[order][:-1]) | (score[order][1:] != score[order][:-1])])
            n, pos = (np.add.reduceat(m[order], starts, axis=0) for m in (w, w * y[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(fold[order][starts].tolist()), pa.array(score[order][starts]), *_packed(n, pos)], ["fold", "score", "wide", "n", "pos"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each fold of a partition: its weights of rows and positives."""
    sums: dict = {}
    for batch in batches:
        if batch.num_rows:
            fold, (n, pos) = np.array(batch.column("fold").to_pylist()), _opened(batch)
            for f in np.unique(fold):
                sums[f] = sums.get(f, 0) + np.stack([n[fold == f].sum(0), pos[fold == f].sum(0)])
    if sums:
        columns = [pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32()), pa.array([str(f) for f in sums]), *[_array(np.stack([s[i] for s in sums.values()])) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, ["part", "fold", "n", "pos"])


def _parts(before: dict):
    """Precision summed over the positives of a partition's scores, given the weights of the partitions of higher scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, running, found = TaskContext.get().partitionId(), {}, {}
        last: dict = {}

        def close(f, n: np.ndarray, pos: np.ndarray) -> None:
            """Adds scores of a fold, all their rows seen, in order."""
            if f not in found:
                start = before.get((part, f), (0, 0))
                running[f], found[f] = (start[0] + np.zeros(n.shape[1], np.int64), start[1] + np.zeros(n.shape[1], np.int64)), np.zeros(n.shape[1])
            upto_n, upto_pos = running[f][0] + np.cumsum(n, axis=0), running[f][1] + np.cumsum(pos, axis=0)
            found[f] = found[f] + (pos * (upto_pos / np.maximum(upto_n, 1))).sum(0)
            running[f] = upto_n[-1], upto_pos[-1]

        for batch in batches:
            if not batch.num_rows:
                continue
            folds, scores, (n, pos) = np.array(batch.column("fold").to_pylist()), batch.column("score").to_numpy(), _opened(batch)
            for f in np.unique(folds).tolist():
                s, own_n, own_pos = scores[folds == f], n[folds == f], pos[folds == f]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                s, own_n, own_pos = s[starts], np.add.reduceat(own_n, starts, axis=0), np.add.reduceat(own_pos, starts, axis=0)
                if f in last and last[f][0] == s[0]:
                    own_n[0] += last[f][1]
                    own_pos[0] += last[f][2]
                elif f in last:
                    close(f, last[f][1][None], last[f][2][None])
                if len(s) > 1:
                    close(f, own_n[:-1], own_pos[:-1])
                last[f] = s[-1], own_n[-1], own_pos[-1]
        for f, (_, n, pos) in last.items():
            close(f, n[None], pos[None])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), _array(np.stack(list(found.values())))], ["fold", "sums"])

    return run


def average_precisions(df: DataFrame, fold: str, score: str, y: str, w: str) -> DataFrame:
    """fold, b and ap: the average precision of each fold in each resample, equal scores as one step, null without positives.

    w is an array of weights, one for each resample. Rows are dealt by ranges of scores; a range's sums are carried to the ranges below as one row
    for each fold and range, so no order is made in one task, and rows are never multiplied by the resamples.
    """
    spark = ship(df.sparkSession)
    shared_folder(spark)
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(F.col(fold).cast("string").alias("fold"), F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y"), F.col(w).alias("w"))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    order = [F.desc("score"), "fold"]
    ranged = rows.mapInArrow(_combined, STEPS).repartitionByRange(parts, F.desc("score")).sortWithinPartitions(*order).checkpoint()
    running, before = {}, {}
    for r in ranged.mapInArrow(_totals, "part int, fold string, n array<long>, pos array<long>").orderBy("part").toLocalIterator():
        n, pos = np.array(r["n"]), np.array(r["pos"])
        held = running.get(r["fold"], (0 * n, 0 * pos))
        before[r["part"], r["fold"]] = held
        running[r["fold"]] = held[0] + n, held[1] + pos
    summed = ranged.mapInArrow(_parts(before), "fold string, sums array<double>").select("fold", F.posexplode("sums").alias("b", "sum")).groupBy("fold", "b").agg(F.sum("sum").alias("sum"))
    totals = spark.createDataFrame([(f, pos.tolist()) for f, (_, pos) in running.items()], "fold string, pos array<long>").select("fold", F.posexplode("pos").alias("b", "pos"))
    return totals.join(summed, ["fold", "b"], "left").select("fold", "b", F.try_divide("sum", F.col("pos").cast("double")).alias("ap"))


def paired_precision(df: DataFrame, cluster: str, fold: str, y: str, first: str, second: str, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """b, ap_first, ap_second and gain (second minus first) of each resample, both scores on the same draws; a fold without a positive in a resample is left out."""
    both_drawn = drawn(df, cluster, n_boot, seed)
    of = lambda score, name: average_precisions(both_drawn, fold, score, y, "_w").withColumnRenamed("ap", name)
    both = of(first, "ap_first").join(of(second, "ap_second"), ["fold", "b"])
    mean = both.groupBy("b").agg(F.avg("ap_first").alias("ap_first"), F.avg("ap_second").alias("ap_second"))
    return mean.withColumn("gain", F.col("ap_second") - F.col("ap_first"))


#: Strata whose sums a task holds, some 6 KB each with 200 resamples, before it hands them on; sums of a cluster in a stratum.
STRATA, SUMS = 2_000, ["n1", "s1", "n0", "s0"]


def _weighed(strata: list[str], n_boot: int):
    """The sums of each stratum of a partition in every resample, each row's sums times its cluster's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def told() -> pa.RecordBatch:
            kinds = [schema.field(c).type for c in strata]
            out = pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in held], t) for i, t in enumerate(kinds)], *[_array(np.stack([v[i] for v in held.values()])) for i in range(len(SUMS))]], [*strata, *SUMS])
            held.clear()
            return out

        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(c).to_pylist() for c in strata])) if strata else [()] * batch.num_rows
            codes: dict = {}
            code = np.array([codes.setdefault(k, len(codes)) for k in keys])
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            w = batch.column("_w").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_boot)[order]
            # A row that a resample leaves out adds nothing to it, whatever its value.
            sums = np.stack([np.add.reduceat(np.where(w > 0, w * batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[order][:, None], 0.0), starts, axis=0) for c in SUMS], axis=1)
            for k, n in codes.items():
                held[k] = held[k] + sums[n] if k in held else sums[n]
            if len(held) > STRATA:
                yield told()
        if held:
            yield told()

    return run


def matched_difference(rows: DataFrame, cluster: str, value: str, strata: list[str], group: str, base: str, n_boot: int = 200, seed: int = 0, drawn_: DataFrame | None = None) -> DataFrame:
    """One row: the difference of rows in group to rows in base over strata that have both, weighed by the group's rows; its 95% interval and p by
    resampled clusters, the group's mean, the strata-matched base mean and the share of the group's rows that is matched.

    A cluster's sums in a stratum come first; they meet the resamples inside a task and are combined there as arrays, so a task hands on a row for each stratum
    and no row is multiplied by the resamples. Rows without a cluster count in the estimate, not in the resamples. drawn_ has draws() of the same n_boot and
    seed, where several differences share them.
    """
    spark = ship(rows.sparkSession)
    y, in_group, in_base = F.col(value), F.col(group), F.col(base)
    part = lambda flag, f: f(F.when(flag, y))
    known = rows.where(y.isNotNull() & (in_group | in_base))
    sums = stored(known.groupBy(cluster, *strata).agg(part(in_group, F.count).alias("n1"), part(in_group, F.sum).alias("s1"), part(in_base, F.count).alias("n0"), part(in_base, F.sum).alias("s0")))

    def estimate(df: DataFrame, keys: list[str]) -> DataFrame:
        used = (F.col("n1") > 0) & (F.col("n0") > 0)
        n = F.sum(F.when(used, F.col("n1")))
        inside, outside = F.sum(F.when(used, F.col("s1"))), F.sum(F.when(used, F.col("n1") * F.col("s0") / F.col("n0")))
        return df.groupBy(*keys).agg(((inside - outside) / n).alias("d"), (F.sum("s1") / F.sum("n1")).alias("mean_in"), (outside / n).alias("mean_out"), (n / F.sum("n1")).alias("matched"))

    total = lambda df, keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n1", "s1", "n0", "s0")])
    point = estimate(total(sums, strata), [])
    kinds = ", ".join([*[f"`{c}` {known.schema[c].dataType.simpleString()}" for c in strata], *[f"{c} array<double>" for c in SUMS]])
    drawn_ = draws(sums, cluster, n_boot, seed) if drawn_ is None else drawn_
    met = sums.join(drawn_, cluster).select(*strata, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SUMS], "_w")
    each = met.mapInArrow(_weighed(strata, n_boot), kinds).select(*strata, F.posexplode(F.arrays_zip(*SUMS)).alias("_b", "_s")).select("_b", *strata, "_s.*")
    boot = estimate(total(each, ["_b", *strata]), ["_b"]).where("d IS NOT NULL")
    below, above = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    p = F.greatest(F.least(F.lit(1.0), 2 * F.least(below, above)), F.lit(1.0 / n_boot))
    spread = boot.agg(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), p.alias("p"))
    return point.crossJoin(F.broadcast(spread)).select(F.col("d").alias("extra"), "lo", "hi", "p", "mean_in", "mean_out", "matched")
