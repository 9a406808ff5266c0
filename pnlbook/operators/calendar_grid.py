"""Calendar grid and week totals.

A month is shown as rows of 7 cells, Sunday first, with blank cells before
the 1st and after the last day. The grid is generated per (user, month)
with ``explode(sequence(...))`` - no cross join - and left-joined to the
daily sums of only the requested months (a pushed-down date range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pnlbook.functions.text import month_key, month_label, pnl_sign, trade_count_text
from pnlbook.operators.filters import date_range, month_bounds
from pnlbook.operators.summaries import daily_summary
from pnlbook.schemas import TOTAL


def month_cells(users: DataFrame, months: list[str]) -> DataFrame:
    """One row per (user, month, cell): week_index, dow (0 = Sunday) and
    date (NULL for a blank cell)."""
    firsts = F.array(*[F.lit(month_bounds(m)[0]) for m in months])
    um = users.select(F.col("id").alias("user_id"), F.explode(firsts).alias("first"))
    lead = F.dayofweek(F.col("first")) - 1                      # blanks before the 1st
    ndays = F.dayofmonth(F.last_day(F.col("first")))
    ncells = F.ceil((lead + ndays) / F.lit(7)).cast("int") * 7
    cells = um.select("user_id", "first", lead.alias("lead"), ndays.alias("ndays"),
                      F.explode(F.sequence(F.lit(0), ncells - 1)).alias("cell"))
    day = F.col("cell") - F.col("lead")                          # 0-based day of month
    return cells.select(
        "user_id",
        month_key(F.col("first")).alias("month"),
        (F.col("cell") / 7).cast("int").alias("week_index"),
        (F.col("cell") % 7).cast("int").alias("dow"),
        F.when((day >= 0) & (day < F.col("ndays")), F.date_add(F.col("first"), day))
         .alias("date"),
        month_label(F.col("first")).alias("month_label"),
    )


def calendar_grid(trades: DataFrame, users: DataFrame, months: list[str]) -> DataFrame:
    """every cell with trade_count, pnl, day_class ('empty', 'profit',
    'loss' - a zero day is 'loss'), pnl_sign ('pos' if pnl >= 0) and the
    texts. Days without trades: count 0, pnl NULL."""
    lo = min(month_bounds(m)[0] for m in months)
    hi = max(month_bounds(m)[1] for m in months)
    daily = daily_summary(date_range(trades.select("user_id", "date", "pnl", "type"), lo, hi))
    grid = month_cells(users, months)
    g = grid.join(daily.select("user_id", "date", "trade_count", "daily_pnl"),
                  ["user_id", "date"], "left")
    n = F.coalesce(F.col("trade_count"), F.lit(0).cast("bigint"))
    pnl = F.col("daily_pnl")
    return g.select(
        "user_id", "month", "week_index", "dow", "date",
        n.alias("trade_count"),
        pnl.cast(TOTAL).alias("pnl"),
        F.when(n == 0, F.lit("empty")).when(pnl > 0, F.lit("profit")).otherwise(F.lit("loss"))
         .alias("day_class"),
        F.when(n > 0, pnl_sign(pnl)).alias("pnl_sign"),
        "month_label",
        F.when(n > 0, trade_count_text(n)).alias("count_text"),
    )


def calendar_weeks(grid: DataFrame) -> DataFrame:
    """one total per calendar row (days of the month only), 0 when the
    row has no trades, and its sign."""
    return (grid.groupBy("user_id", "month", "week_index")
            .agg(F.coalesce(F.sum("pnl"), F.lit(0)).cast(TOTAL).alias("week_pnl"))
            .withColumn("week_sign", pnl_sign(F.col("week_pnl"))))
