"""Daily and monthly summaries (E1, E2): the two SQL views of the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pnlbook.functions.money import ratio_half_up
from pnlbook.functions.text import month_key
from pnlbook.schemas import FACTOR, RATE, TOTAL


def _win(c="pnl"):
    return F.col(c) > 0


def _loss(c="pnl"):
    return F.col(c) < 0


def daily_summary(trades: DataFrame) -> DataFrame:
    """Per (user, date): trade_count, daily_pnl, wins, losses, longs, shorts."""
    return (trades.groupBy("user_id", "date")
            .agg(F.count(F.lit(1)).alias("trade_count"),
                 F.sum("pnl").cast(TOTAL).alias("daily_pnl"),
                 F.count_if(_win()).alias("wins"),
                 F.count_if(_loss()).alias("losses"),
                 F.count_if(F.col("type") == "LONG").alias("longs"),
                 F.count_if(F.col("type") == "SHORT").alias("shorts")))


def monthly_summary(trades: DataFrame) -> DataFrame:
    """Per (user, yyyy-MM). win_rate_pct to 1 place; profit_factor =
    gross win / |gross loss| to 2 places, NULL with no loss, 0 with no win."""
    agg = (trades.groupBy("user_id", F.trunc("date", "month").alias("first"))
           .agg(F.count(F.lit(1)).alias("trade_count"),
                F.sum("pnl").alias("net_pnl"),
                F.count_if(_win()).alias("wins"),
                F.count_if(_loss()).alias("losses"),
                F.sum(F.when(_win(), F.col("pnl")).otherwise(0)).alias("gross_win"),
                F.sum(F.when(_loss(), -F.col("pnl")).otherwise(0)).alias("gross_loss")))
    return agg.select(
        "user_id", month_key(F.col("first")).alias("month"), "trade_count",
        F.col("net_pnl").cast(TOTAL).alias("net_pnl"),
        "wins", "losses",
        ratio_half_up(F.col("wins") * 100, F.col("trade_count"), 1, RATE.simpleString())
        .alias("win_rate_pct"),
        ratio_half_up(F.col("gross_win"), F.col("gross_loss"), 2, FACTOR.simpleString())
        .alias("profit_factor"),
    )
