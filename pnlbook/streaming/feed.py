"""Staging a table as an ordered file feed, for stream runs and tests.

A change feed must reach the fold in ``seq`` order. A file source orders
new files by modification time only, so instead of relying on that, each
slice of the feed is written and then consumed by one ``availableNow``
run before the next slice is written; every run restarts from the same
checkpoint. Slices are written by normal (parallel) Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seq_bounds(df: DataFrame, order_col: str, parts: int) -> list[int]:
    """``parts`` + 1 cut points of equal width over [min, max] of the key (all 0 for an empty feed)."""
    row = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    if row["lo"] is None:
        return [0] * (parts + 1)
    lo, hi = int(row["lo"]), int(row["hi"]) + 1
    step = max(1, -(-(hi - lo) // parts))
    return [lo + i * step for i in range(parts)] + [hi]


def feed_in_slices(df: DataFrame, order_col: str, parts: int, path: str,
                   after_each: Callable[[int], None]) -> None:
    """Append slice i (order_col in [cut_i, cut_i+1)) to ``path`` as parquet,
    then call ``after_each(i)`` (which runs the stream over what is there)."""
    cuts = seq_bounds(df, order_col, parts)
    for i in range(parts):
        part = df.filter((F.col(order_col) >= cuts[i]) & (F.col(order_col) < cuts[i + 1]))
        part.write.mode("append").parquet(path)
        after_each(i)
