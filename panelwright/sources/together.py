"""Independent Spark jobs submitted together, so that the cores one of them leaves idle are used by another."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Fits at a time; each keeps its own training rows in memory, or on disk where memory is short.
AT_ONCE = 3


def together(spark: SparkSession, of: Callable, items: Iterable, at_once: int = AT_ONCE) -> list:
    """of(item) for each item, in their order; an error is raised once the others have ended."""

    def target() -> Callable:
        # Properties of its own for each item: jobs note in them what they belong to.
        wrap = inheritable_thread_target(spark)
        return of if wrap is spark else wrap(of)

    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(target(), i) for i in items]]
