"""Consistency, edge scores and card labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pnlbook.functions.money import dec, ratio_half_up
from pnlbook.functions.text import (currency, factor_text, number_text,
                                    positive_money_text, rr_text)
from pnlbook.operators.curve import daily_pnl
from pnlbook.operators.filters import trailing_days
from pnlbook.schemas import SCORE, SHARE, TOTAL

# Fixed thresholds of the scores.
GOOD_BELOW = 30          # consistency percent below this is 'good'
POOR_ABOVE = 50          # above this 'poor'; between is 'fair'
FULL_SCORE_AT = 3        # profit factor / R multiple that scores 100
WIN_RATE_GREEN_AT = 50
FACTOR_GREEN_AT = 1


def consistency(trades: DataFrame, users: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """G1 + G2: best day / net x 100 (1 place) when net > 0, else NULL;
    band on the unrounded ratio: good < 30, poor > 50, else fair; 'none'
    when net <= 0. Built from daily sums: one row per user and day."""
    t = trailing_days(trades.select("user_id", "date", "pnl"), as_of, days)
    return consistency_from_daily(daily_pnl(t), users)


def consistency_from_daily(daily: DataFrame, users: DataFrame) -> DataFrame:
    """G1 + G2 over daily sums (user_id, date, daily_pnl)."""
    per_user = (daily.groupBy("user_id")
                .agg(F.sum("daily_pnl").alias("net"), F.max("daily_pnl").alias("_max")))
    return consistency_from_best(per_user, users)


def consistency_from_best(per_user: DataFrame, users: DataFrame) -> DataFrame:
    """G1 + G2 from each user's net and greatest daily sum (user_id, net, _max)."""
    ids = users.select(F.col("id").alias("user_id"))
    df = ids.join(per_user, "user_id", "left").select(
        "user_id",
        F.coalesce(F.col("net"), dec(0)).cast(TOTAL).alias("net"),
        F.greatest(F.coalesce(F.col("_max"), dec(0)), dec(0)).cast(TOTAL).alias("best_day"))
    net, best = F.col("net"), F.col("best_day")
    return df.withColumns({
        "consistency_pct": F.when(net > 0, ratio_half_up(best * 100, net, 1, SHARE.simpleString())),
        "band": F.when(net <= 0, F.lit("none"))
                 .when(best * 100 < net * GOOD_BELOW, F.lit("good"))
                 .when(best * 100 > net * POOR_ABOVE, F.lit("poor"))
                 .otherwise(F.lit("fair")),
    })


def _score(x):
    """min(100, x / 3 x 100) to 4 places."""
    return (F.when(x >= FULL_SCORE_AT, dec(100).cast(SCORE))
            .when(x.isNotNull(), ratio_half_up(F.least(x, F.lit(FULL_SCORE_AT)) * 100, F.lit(FULL_SCORE_AT), 4, SCORE.simpleString())))


def edge_scores(card: DataFrame) -> DataFrame:
    """G3 from the stat card: win score = win rate; profit-factor score
    (100 when unbounded); R-multiple score (0 without a ratio)."""
    return card.select(
        "user_id",
        F.col("win_rate").cast(SCORE).alias("win_score"),
        F.when(F.col("pf_unbounded"), dec(100).cast(SCORE))
         .otherwise(F.coalesce(_score(F.col("profit_factor")), dec(0).cast(SCORE)))
         .alias("pf_score"),
        F.coalesce(_score(F.col("avg_rr")), dec(0).cast(SCORE)).alias("rr_score"),
    )


def card_labels(card: DataFrame) -> DataFrame:
    """G4 + H1/H6: the card's texts and colour classes."""
    net, wr, pf, rr = (F.col(c) for c in ("net_pnl", "win_rate", "profit_factor", "avg_rr"))
    return card.select(
        "user_id",
        currency(net).alias("net_text"),
        F.concat(number_text(wr), F.lit("%")).alias("wr_text"),
        factor_text(pf, F.col("pf_unbounded")).alias("pf_text"),
        rr_text(rr).alias("rr_text"),
        positive_money_text(F.col("avg_win")).alias("avg_win_text"),
        positive_money_text(F.col("avg_loss"), negate=True).alias("avg_loss_text"),
        F.when(net > 0, F.lit("green")).when(net < 0, F.lit("red")).otherwise(F.lit("neutral"))
         .alias("net_class"),
        F.when(wr >= WIN_RATE_GREEN_AT, F.lit("green")).otherwise(F.lit("red")).alias("wr_class"),
        F.when(F.col("pf_unbounded") | (pf >= FACTOR_GREEN_AT), F.lit("green"))
         .otherwise(F.lit("red")).alias("pf_class"),
        F.when(rr.isNull(), F.lit("neutral")).when(rr >= 1, F.lit("green"))
         .otherwise(F.lit("red")).alias("rr_class"),
    )
