"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.sources.scratch import removed, saved, stored
from panelwright.sources.session import shared_folder, ship

__all__ = ["SPACE", "cut", "let", "removed", "saved", "steps", "stored", "table", "text_udf", "words"]

#: White space that separates words: space, tab, newline, vertical tab, form feed, return.
SPACE = "\\x20\\x09-\\x0D"
#: Most texts that a Python worker holds as objects at a time, and their bytes (a longer text goes alone).
STEP_TEXTS, STEP_BYTES = 256, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed; for slim rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is not inlined into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of text, maximal runs of characters other than white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of consecutive parts of texts, each of at most STEP_TEXTS texts and STEP_BYTES bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = min(at + STEP_TEXTS, max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right"))))
        yield at, min(upto, len(ends)) - at
        at = upto


def text_udf(returns: str, prepare):
    """A column function of a text column and others: prepare() makes, once a task, a function from a list of texts and
    lists of the others' values to the results, which are rows' Python values. What it keeps goes with the task."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    kind = T.DataType.fromDDL(returns)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work, out = prepare(), to_arrow_type(kind)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at, n in steps(columns[0]):
                yield pa.array(work(*(c.slice(at, n).to_pylist() for c in columns)), out)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else run, kind)(*columns)
