"""Cross-checks between results that must agree."""

from pyspark.sql import functions as F

from pnlbook.operators import calendar_grid, curve, stats, summaries
from pnlbook.plans.context import Journal
from tests.conftest import SF_SMALL


def _j(spark):
    return Journal(spark, SF_SMALL)


def test_daily_sums_equal_api_totals(spark):
    j = _j(spark)
    d = summaries.daily_summary(j.trades).groupBy("user_id").agg(
        F.sum("trade_count").alias("n"), F.sum("daily_pnl").alias("p"),
        F.sum("longs").alias("l"), F.sum("shorts").alias("s"))
    a = stats.api_stats(j.trades, j.users)
    bad = (a.join(d, "user_id")
           .filter((F.col("total") != F.col("n")) | (F.col("net_pnl") != F.col("p"))
                   | (F.col("longs") != F.col("l")) | (F.col("shorts") != F.col("s"))))
    assert bad.count() == 0


def test_curve_ends_at_net(spark):
    j = _j(spark)
    last = curve.equity_curve(j.trades).groupBy("user_id").agg(
        F.max_by("cum_pnl", "date").alias("last"))
    card = stats.stat_card(j.trades, j.users)
    assert last.join(card, "user_id").filter(F.col("last") != F.col("net_pnl")).count() == 0


def test_weeks_sum_to_month_net(spark):
    j = _j(spark)
    months = ["1998-06", "1998-07"]
    w = calendar_grid.calendar_weeks(calendar_grid.calendar_grid(j.trades, j.users, months))
    per_month = w.groupBy("user_id", "month").agg(F.sum("week_pnl").alias("w"))
    m = summaries.monthly_summary(j.trades).filter(F.col("month").isin(months))
    joined = per_month.join(m, ["user_id", "month"], "left")
    bad = joined.filter(F.coalesce(F.col("net_pnl"), F.lit(0)) != F.col("w"))
    assert bad.count() == 0
    g = calendar_grid.calendar_grid(j.trades, j.users, months)
    sizes = g.groupBy("user_id", "month").count()
    assert sizes.filter(F.col("count") % 7 != 0).count() == 0


def test_wins_losses_flat_add_up(spark):
    j = _j(spark)
    c = stats.stat_card(j.trades, j.users)
    flat = j.trades.groupBy("user_id").agg(F.count_if(F.col("pnl") == 0).alias("flat"))
    bad = c.join(flat, "user_id", "left").filter(
        F.col("wins") + F.col("losses") + F.coalesce(F.col("flat"), F.lit(0)) != F.col("total"))
    assert bad.count() == 0


def test_month_stats_agree_with_monthly_summary(spark):
    j = _j(spark)
    a = stats.month_stats(j.trades)
    b = summaries.monthly_summary(j.trades)
    bad = a.join(b, ["user_id", "month"]).filter(
        (F.col("total") != F.col("trade_count")) | (a["net_pnl"] != b["net_pnl"])
        | (F.col("win_rate") != F.col("win_rate_pct")))
    assert bad.count() == 0


def test_dashboard_equals_single_results(spark):
    from pnlbook.operators import scores
    from pnlbook.plans.dashboard import dashboard, release
    j = _j(spark)
    as_of = "2001-08-01 12:00:00"
    d = dashboard(j.trades, j.users, as_of, 90)
    try:
        pairs = [
            (d["card"], stats.stat_card(j.trades, j.users)),
            (d["curve"], curve.equity_curve_range(j.trades, as_of, 90)),
            (d["best_day"], stats.best_day(j.trades, j.users)),
            (d["consistency"], scores.consistency(j.trades, j.users)),
            (d["labels"], scores.card_labels(stats.stat_card(j.trades, j.users))),
        ]
        for a, b in pairs:
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    finally:
        release(d)
