"""The dashboard: several results from one ledger read.

The daily sums are computed once and persisted; the curve, the best day and
the consistency score read them instead of aggregating the trades again.
The card reads the trades (it needs per-trade wins and losses), and the
edge scores and labels read the card.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pnlbook.operators import curve, filters, scores, stats
from pnlbook.operators.summaries import daily_summary


def dashboard(trades: DataFrame, users: DataFrame, as_of, days: int | None = 30) -> dict:
    """Card, edge scores, labels, the curve over the chart range, best day
    and consistency, for all users. Call ``release(result)`` when done."""
    t = trades.select("user_id", "date", "type", "pnl")
    daily = daily_summary(t).persist(StorageLevel.MEMORY_AND_DISK)
    card = stats.stat_card(t, users).persist(StorageLevel.MEMORY_AND_DISK)
    cutoff = None if days is None else filters.trailing_cutoff(as_of, days)
    in_range = daily if cutoff is None else daily.filter(F.col("date") >= F.lit(cutoff))
    return {
        "daily": daily,
        "card": card,
        "edge": scores.edge_scores(card),
        "labels": scores.card_labels(card),
        "curve": curve.curve_from_daily(in_range),
        "best_day": stats.best_day_from_daily(daily, users),
        "consistency": scores.consistency_from_daily(daily, users),
    }


def release(result: dict) -> None:
    for k in ("daily", "card"):
        result[k].unpersist()
