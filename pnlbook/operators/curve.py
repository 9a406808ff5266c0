"""Cumulative PnL curve.

The running sum is a window over *daily* sums partitioned by user, so a
window partition holds one row per trading day, whatever the number of
trades of that user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pnlbook.operators.filters import trailing_days
from pnlbook.schemas import TOTAL


def daily_pnl(trades: DataFrame) -> DataFrame:
    return (trades.groupBy("user_id", "date")
            .agg(F.sum("pnl").cast(TOTAL).alias("daily_pnl")))


def curve_from_daily(daily: DataFrame) -> DataFrame:
    """F1 over daily sums (user_id, date, daily_pnl)."""
    w = (Window.partitionBy("user_id").orderBy("date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (daily.select("user_id", "date", "daily_pnl")
            .withColumn("cum_pnl", F.round(F.sum("daily_pnl").over(w), 2).cast(TOTAL)))


def equity_curve(trades: DataFrame) -> DataFrame:
    """user_id, date, daily_pnl, cum_pnl; days without trades make no point."""
    return curve_from_daily(daily_pnl(trades.select("user_id", "date", "pnl")))


def equity_curve_range(trades: DataFrame, as_of, days: int | None) -> DataFrame:
    """the range first, so the total starts at 0 inside it."""
    return equity_curve(trailing_days(trades, as_of, days))


def curve_end(trades: DataFrame, as_of, days: int | None) -> DataFrame:
    """last cumulative value per user (= the sum over the range) and
    the line's trend. Users with no trade in range have no curve."""
    t = trailing_days(trades.select("user_id", "date", "pnl"), as_of, days)
    return (t.groupBy("user_id").agg(F.sum("pnl").cast(TOTAL).alias("final_pnl"))
            .withColumn("trend", F.when(F.col("final_pnl") >= 0, F.lit("up"))
                        .otherwise(F.lit("down"))))
