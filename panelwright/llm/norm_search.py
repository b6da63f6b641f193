"""Exact search by inner product over buckets of equal norm, and hard negatives by it (operator 11).

Candidates are sorted by norm and packed in blocks of at most BLOCK rows of one dimension; a block knows its largest norm. Blocks are dealt
over tasks and each task meets its own from the largest norm downwards. Queries are packed likewise, with windows of scores, and broadcast in rounds
of at most QUERY_BYTES; the join is by dimension. By the inequality of Cauchy and Schwarz no score exceeds the product of the two
norms: a pair of blocks is left out of the join where that lies below the least lower limit of the queries' windows, and a query
skips a block where it lies below each of its windows' lower limits or the kth score that the task has so far. The bound is rounded up
and pruning is strict, so ties are kept. Scores are whole numbers, computed as doubles where those are exact and as longs elsewhere.
Each task returns the first k of each window, and Spark ranks them.

Rows whose label or vector is null, or has a component that is null or not finite, take no part. Rows are told apart by a row number, not
their id: ids may repeat, and null ids come last among equal scores (equal ids by row number). A query is scored against rows of as many
components as its own. Numbers beyond vectors.LARGEST are taken as that. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import vectors
from panelwright.llm.common import saved, stored
from panelwright.sources.session import ship

#: Rows of a block, rows of a partition that is packed, bytes of the queries broadcast at a time.
BLOCK, PACKED, QUERY_BYTES = 1024, 65_536, 32 << 20
NONE, EXACT = -(1 << 63), 1 << 52
#: The product of two norms is rounded up by this.
ABOVE = 1 + 1e-9
PACK = "block long, dim int, top double, least double, n int, x binary, rows binary, ids binary, absent binary, labels binary, low binary, high binary"
FOUND = "query long, window int, score long, absent boolean, id long, row long"


def rows_of(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """row, id, label, x (whole numbers) and norm of the rows that take part, written once."""
    named = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    whole = named.where(vectors.is_finite(F.col("v")) & F.col("label").isNotNull()).withColumn("x", vectors.whole(F.col("v"))).drop("v")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return stored(whole.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by dimension and norm."""
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        sizes = columns["x"].value_lengths().to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, int)
        starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        cuts = [(at, min(BLOCK, end - at)) for begin, end in zip(starts, starts[1:]) for at in range(begin, end, BLOCK)]
        for at, n in cuts:
            own = {name: c.slice(at, n) for name, c in columns.items()}
            x = own["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            wide = x.reshape(n, -1).astype(np.float64)
            ids = own["id"]
            low, high = (own[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) if c in own else np.zeros(0, np.int64) for c in ("low", "high"))
            limits = low[low <= high]
            values = [
                block,
                int(sizes[at]),
                float(np.sqrt((wide * wide).sum(1)).max()) * ABOVE,
                float(limits.min()) if len(limits) else float("inf"),
                n,
                x.tobytes(),
                own["row"].to_numpy().astype(np.int64).tobytes(),
                ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
                ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                own["label"].to_numpy().astype(np.int64).tobytes(),
                low.tobytes(),
                high.tobytes(),
            ]
            names = [c.split()[0] for c in PACK.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)
            block += 1


def packed(rows: DataFrame, n: int, dealt: int | None = None) -> DataFrame:
    """Blocks of n rows in the order of their norms, written once; dealt is over how many files."""
    wide = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // PACKED), min(wide, -(-n // BLOCK)))
    order = [F.size("x"), F.desc("norm"), "row"]
    blocks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack, PACK)
    return stored(blocks.repartition(dealt, "block").sortWithinPartitions(F.desc("top"), "block") if dealt else blocks)


class Block:
    """A packed block's arrays."""

    def __init__(self, row: dict):
        number = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.n, self.top = row["n"], row["top"]
        self.x = number("x", np.int32).reshape(self.n, -1)
        self.rows, self.ids, self.absent, self.labels = number("rows"), number("ids"), number("absent", np.bool_), number("labels")
        self.low, self.high = (number(c).reshape(self.n, -1) if row[c] else None for c in ("low", "high"))
        wide = self.x.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(1)) * ABOVE


class Best:
    """The first k rows so far of each window of a block's queries."""

    def __init__(self, queries: Block, k: int):
        shape = (*queries.low.shape, k)
        self.scores, self.rows, self.ids = np.full(shape, NONE, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.absent = np.zeros(shape, np.bool_)

    def floor(self, queries: Block) -> np.ndarray:
        """The least score that can still enter each window."""
        return np.maximum(queries.low, self.scores[:, :, -1])

    def enter(self, window: int, query: np.ndarray, score: np.ndarray, found: np.ndarray, block: Block) -> None:
        """Merges block's rows found, one for each of query, into the window's lists."""
        k = self.scores.shape[2]
        own = np.unique(query)
        had = self.scores[own, window] != NONE
        old = np.repeat(own, had.sum(1))
        join = lambda kept, new: np.concatenate([kept[own, window][had], new])
        query, score = np.concatenate([old, query]), join(self.scores, score)
        absent, ids, rows = join(self.absent, block.absent[found]), join(self.ids, block.ids[found]), join(self.rows, block.rows[found])
        order = np.lexsort((rows, ids, absent, -score, query))
        sorted_query = query[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query, "left")
        keep = place < k
        order, at = order[keep], (sorted_query[keep], window, place[keep])
        self.scores[at], self.absent[at], self.ids[at], self.rows[at] = score[order], absent[order], ids[order], rows[order]


def meet(queries: Block, block: Block, best: Best, same_label: bool) -> None:
    """Scores a block against the queries that its norms do not exclude."""
    k = best.scores.shape[2]
    floor = best.floor(queries)
    open_ = (queries.low <= queries.high) & ((queries.norms * block.top)[:, None] >= floor)
    live = np.flatnonzero(open_.any(1))
    if not len(live):
        return
    exact = queries.top * block.top < EXACT
    a, b = (x.astype(np.float64 if exact else np.int64) for x in (queries.x[live], block.x))
    scores = (a @ b.T).astype(np.int64)
    allowed = (queries.labels[live][:, None] == block.labels[None, :]) == same_label
    if same_label:
        allowed &= queries.rows[live][:, None] != block.rows[None, :]
    for w in range(floor.shape[1]):
        fits = allowed & (scores >= floor[live, w][:, None]) & (scores <= queries.high[live, w][:, None]) & open_[live, w][:, None]
        if fits.sum(1).max(initial=0) > 2 * k:
            kth = np.partition(np.where(fits, scores, NONE), block.n - k, axis=1)[:, block.n - k]
            fits &= scores >= kth[:, None]
        query, found = np.nonzero(fits)
        if len(query):
            best.enter(w, live[query], scores[query, found], found, block)


def _search(k: int, same_label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, Block] = {}
        best: dict[int, Best] = {}
        now, block = None, None
        for batch in batches:
            own = [n for n in batch.schema.names if not n.startswith("q_")]
            for i in range(batch.num_rows):
                if now != batch.column("block")[i].as_py():
                    block = Block({n: batch.column(n)[i].as_py() for n in own})
                    now = batch.column("block")[i].as_py()
                name = batch.column("q_block")[i].as_py()
                if name not in queries:
                    queries[name] = Block({n: batch.column(f"q_{n}")[i].as_py() for n in own})
                    best[name] = Best(queries[name], k)
                meet(queries[name], block, best[name], same_label)
        names = [c.split()[0] for c in FOUND.split(", ")]
        for name, b in best.items():
            at = query, window, _ = np.nonzero(b.scores != NONE)
            columns = [queries[name].rows[query], window.astype(np.int32), b.scores[at], b.absent[at], b.ids[at], b.rows[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def search(blocks: DataFrame, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """query, window, place (from 1), score, id and row: the first k rows of each window [low, high] of each query, by descending score.

    blocks and queries are as packed() gives them. same_label: whether only rows of the query's label, other than
    itself, or only rows of other labels count.
    """
    spark = ship(blocks.sparkSession)
    size = sum((F.octet_length(c) for c in ("x", "rows", "ids", "labels", "low", "high")), F.octet_length("absent"))
    sized = queries.select("block", size.alias("bytes"))
    rounds: list[list[int]] = [[]]
    held = 0
    for r in sized.orderBy("block").toLocalIterator():
        if held + r["bytes"] > QUERY_BYTES and rounds[-1]:
            rounds, held = [*rounds, []], 0
        rounds[-1].append(r["block"])
        held += r["bytes"]
    paths = []
    for names in filter(None, rounds):
        some = queries.where(F.col("block").between(names[0], names[-1])).select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
        near = (F.col("dim") == F.col("q_dim")) & (F.col("top") * F.col("q_top") >= F.col("q_least"))
        paths.append(saved(blocks.join(F.broadcast(some), near).mapInArrow(_search(k, same_label), FOUND)))
    found = spark.read.schema(FOUND).parquet(*paths) if paths else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "absent", "id", "row")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return first.select("query", "window", "place", "score", F.when(~F.col("absent"), F.col("id")).alias("id"), "row")


def hard_negatives(df: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its first positives the k best rows of other labels whose score is low to high percent of the positive's.

    anchor_id, positive_id, rank, negative_id, positive_score and negative_score. is_anchor is a condition on the column id; label one on df's columns.
    An anchor's positives are its best other rows of the same label. A positive of negative score has no negatives: its window is empty.
    """
    rows = rows_of(df, key, vector, label)
    n = rows.count()
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    n_anchors = anchors.count()
    if not n_anchors:
        return _told(df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, place int, id long, positive_score long, score long"))
    wide = df.sparkSession.sparkContext.defaultParallelism
    blocks = packed(rows, n, dealt=max(1, min(-(-n // BLOCK), 3 * wide)))
    limit = lambda x: F.array(F.lit(x).cast("long"))
    every = packed(anchors.withColumn("low", limit(NONE)).withColumn("high", limit(-1 - NONE)), n_anchors)
    liked = stored(search(blocks, every, positives, True))

    # whole numbers s with low * p <= 100 * s <= high * p
    at_least, at_most = F.ceil(F.col("score").cast("decimal(20,0)") * low / 100), F.floor(F.col("score").cast("decimal(20,0)") * high / 100)
    limits = liked.where("score >= 0").select("query", F.struct("place", at_least.cast("long").alias("low"), at_most.cast("long").alias("high")).alias("w"))
    lists = limits.groupBy("query").agg(F.array_sort(F.collect_list("w")).alias("w"))
    nothing = F.array_repeat(F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")), positives)
    asked = anchors.join(lists, F.col("row") == F.col("query")).withColumn("w", F.slice(F.concat(F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))), nothing), 1, positives))
    told = asked.withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high")).select(*anchors.columns, "low", "high")
    negatives = search(blocks, packed(told, n_anchors), k, False).select("query", (F.col("window") + 1).alias("positive"), "place", "id", "score")
    pairs = liked.select("query", F.col("place").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    owners = anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor_id"))
    return _told(negatives.join(pairs, ["query", "positive"]).join(owners, "query"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
