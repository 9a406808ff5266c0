"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension side is broadcast only when it is known to be small: by the size of
# the files it is read from (the plan's own statistics, no job runs), or, where
# that is larger or unknown, when a count proves it at most so many rows and so
# many bytes of its row type. Above that the join is left to a shuffle join (and
# AQE). A session can change the row bound with the conf key below.
BROADCAST_MAX_FILE_BYTES = 16 * 1024 ** 2
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 256 * 1024 ** 2
BROADCAST_MAX_ROWS_CONF = "pnlbook.broadcast.maxRows"


def bounded_broadcast(small: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``broadcast(small)`` if its size is proven small, else ``small`` unchanged,
    for which Spark plans a shuffle join.

    A count runs only where the statistics do not settle it, and on the small side
    only (a dimension table). Rows are taken at the default size of their type, which
    bounds fixed-width columns and estimates text.
    """
    if max_rows is None:
        conf = small.sparkSession.conf.get(BROADCAST_MAX_ROWS_CONF, None)
        max_rows = int(conf) if conf else BROADCAST_MAX_ROWS
    plan = small._jdf.queryExecution().optimizedPlan()
    if max_rows >= BROADCAST_MAX_ROWS and int(str(plan.stats().sizeInBytes())) <= BROADCAST_MAX_FILE_BYTES:
        return F.broadcast(small)
    width = small._jdf.schema().defaultSize() + 8
    n = small.count()
    return F.broadcast(small) if n <= max_rows and n * width <= BROADCAST_MAX_BYTES else small
