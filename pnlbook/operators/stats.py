"""Per-user statistics (E3-E9) from one shared set of aggregates.

Every statistic is a single ``groupBy`` with conditional aggregates (one
pass, partial aggregation before the shuffle, so a user with a third of all
trades is summed map-side). Users with no trades get a zero row through a
left join from ``users``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pnlbook.functions.money import dec, ratio_half_up
from pnlbook.functions.text import month_key
from pnlbook.operators.summaries import daily_summary
from pnlbook.schemas import FACTOR, RATE, TOTAL

COUNTS = ("total", "wins", "losses", "longs", "shorts")
SUMS = ("net_pnl", "gross_win", "gross_loss")

CARD_COLUMNS = ("total", "wins", "losses", "net_pnl", "gross_win", "gross_loss", "win_rate",
                "profit_factor", "pf_unbounded", "avg_win", "avg_loss", "avg_rr",
                "longs", "shorts")
API_COLUMNS = ("total", "wins", "losses", "win_rate", "profit_factor", "net_pnl",
               "longs", "shorts")


def base_aggs() -> list[Column]:
    """total, wins, losses, net, gross win, |gross loss|, longs, shorts."""
    pnl = F.col("pnl")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(pnl > 0).alias("wins"),
        F.count_if(pnl < 0).alias("losses"),
        F.sum(pnl).alias("net_pnl"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0)).alias("gross_win"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0)).alias("gross_loss"),
        F.count_if(F.col("type") == "LONG").alias("longs"),
        F.count_if(F.col("type") == "SHORT").alias("shorts"),
    ]


def zero_filled(df: DataFrame) -> DataFrame:
    """Counts and sums NULL (no trades) -> 0."""
    fills = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in COUNTS}
    fills.update({c: F.coalesce(F.col(c), dec(0)).cast(TOTAL) for c in SUMS})
    return df.withColumns(fills)


def win_rate(wins: Column, total: Column) -> Column:
    """Percent to 1 place; 0 with no trades."""
    return F.coalesce(ratio_half_up(wins * 100, total, 1, RATE.simpleString()),
                      dec("0.0").cast(RATE))


def card_figures(df: DataFrame) -> DataFrame:
    """E4 from the base aggregates: win rate, profit factor with its
    unbounded flag, average win and loss, reward-to-risk from the rounded
    averages."""
    gw, gl = F.col("gross_win"), F.col("gross_loss")
    zero2 = dec("0.00").cast(FACTOR)
    avg_win = F.coalesce(ratio_half_up(gw, F.col("wins"), 2, FACTOR.simpleString()), zero2)
    avg_loss = F.coalesce(ratio_half_up(gl, F.col("losses"), 2, FACTOR.simpleString()), zero2)
    out = df.withColumns({
        "win_rate": win_rate(F.col("wins"), F.col("total")),
        "profit_factor": F.when(gl > 0, ratio_half_up(gw, gl, 2, FACTOR.simpleString()))
                          .when(gw > 0, F.lit(None).cast(FACTOR))
                          .otherwise(zero2),
        "pf_unbounded": (gl == 0) & (gw > 0),
        "avg_win": avg_win,
        "avg_loss": avg_loss,
    })
    return out.withColumn(
        "avg_rr",
        F.when((F.col("avg_win") > 0) & (F.col("avg_loss") > 0),
               ratio_half_up(F.col("avg_win"), F.col("avg_loss"), 2, FACTOR.simpleString())))


def _per_user(trades: DataFrame) -> DataFrame:
    return trades.groupBy("user_id").agg(*base_aggs())


def _from_users(users: DataFrame, per_user: DataFrame) -> DataFrame:
    ids = users.select(F.col("id").alias("user_id"))
    return zero_filled(ids.join(per_user, "user_id", "left"))


def api_stats(trades: DataFrame, users: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """The stats endpoint for every user over an optional date range
    (both ends included). profit_factor is NULL with no loss."""
    t = trades
    if date_from is not None:
        t = t.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        t = t.filter(F.col("date") <= F.lit(date_to).cast("date"))
    return api_from_sums(_per_user(t.select("user_id", "pnl", "type")), users)


def api_from_sums(per_user: DataFrame, users: DataFrame) -> DataFrame:
    """E3 from the base aggregates per user."""
    df = _from_users(users, per_user)
    gw, gl = F.col("gross_win"), F.col("gross_loss")
    return df.select(
        "user_id", "total", "wins", "losses",
        win_rate(F.col("wins"), F.col("total")).alias("win_rate"),
        ratio_half_up(gw, gl, 2, FACTOR.simpleString()).alias("profit_factor"),
        F.col("net_pnl"), "longs", "shorts")


def stat_card(trades: DataFrame, users: DataFrame) -> DataFrame:
    """E4 per user (all users, zero rows included)."""
    return card_from_sums(_per_user(trades.select("user_id", "pnl", "type")), users)


def card_from_sums(per_user: DataFrame, users: DataFrame) -> DataFrame:
    """E4 from the base aggregates per user."""
    return card_figures(_from_users(users, per_user)).select("user_id", *CARD_COLUMNS)


def account_stats(trades: DataFrame, accounts: DataFrame, users: DataFrame) -> DataFrame:
    """E5: the card per account, plus one row per user over all accounts
    (account_id NULL). A trade counts in each of its accounts; a trade with
    no account counts only in the user's row. Accounts with no trades get
    zero rows; ids in trades that name no account drop out.

    One pass: each trade is exploded into its accounts plus one NULL entry
    (the user's "all" row), and a single aggregate over (user_id,
    account_id) feeds both kinds of rows; the shuffle is shared by the two
    joins that follow.
    """
    # each account once per trade (membership, as `= ANY(list)`), plus "all"
    every = F.concat(F.array_distinct(F.col("account_ids")), F.array(F.lit(None).cast("int")))
    pairs = trades.select("user_id", "type", "pnl", F.explode(every).alias("account_id"))
    return account_cards_from_sums(pairs.groupBy("user_id", "account_id").agg(*base_aggs()), accounts, users)


def account_cards_from_sums(agg: DataFrame, accounts: DataFrame, users: DataFrame) -> DataFrame:
    """E5 from the base aggregates per (user_id, account_id); account NULL = all."""
    keys = (accounts.select("user_id", F.col("id").cast("int").alias("account_id"))
            .unionByName(users.select(F.col("id").alias("user_id"),
                                      F.lit(None).cast("int").alias("account_id"))))
    on = (keys["user_id"] == agg["user_id"]) & keys["account_id"].eqNullSafe(agg["account_id"])
    both = keys.join(agg, on, "left").select(keys["user_id"], keys["account_id"],
                                             *[agg[c] for c in (*COUNTS, *SUMS)])
    cols = ["user_id", "account_id", *CARD_COLUMNS]
    return card_figures(zero_filled(both)).select(*cols)


def month_stats(trades: DataFrame) -> DataFrame:
    """The card per (user, month) with trades."""
    agg = (trades.select("user_id", "pnl", "type", F.trunc("date", "month").alias("first"))
           .groupBy("user_id", "first").agg(*base_aggs()))
    return month_cards_from_sums(agg)


def month_cards_from_sums(agg: DataFrame) -> DataFrame:
    """E6 from the base aggregates per (user_id, first day of the month)."""
    named = card_figures(zero_filled(agg)).withColumn("month", month_key(F.col("first")))
    return named.select("user_id", "month", *CARD_COLUMNS)


def best_day(trades: DataFrame, users: DataFrame) -> DataFrame:
    """Greatest daily PnL, not below 0 (0 with no trades)."""
    return best_day_from_daily(daily_summary(trades.select("user_id", "date", "pnl", "type")), users)


def best_day_from_daily(daily: DataFrame, users: DataFrame) -> DataFrame:
    """E7 over daily sums (user_id, date, daily_pnl)."""
    best = daily.groupBy("user_id").agg(F.max("daily_pnl").alias("_best"))
    ids = users.select(F.col("id").alias("user_id"))
    return (ids.join(best, "user_id", "left")
            .select("user_id", F.greatest(F.coalesce(F.col("_best"), dec(0)), dec(0))
                    .cast(TOTAL).alias("best_day")))


def side_split(trades: DataFrame, users: DataFrame) -> DataFrame:
    """Longs and shorts per user."""
    agg = trades.groupBy("user_id").agg(F.count_if(F.col("type") == "LONG").alias("longs"),
                                        F.count_if(F.col("type") == "SHORT").alias("shorts"))
    ids = users.select(F.col("id").alias("user_id"))
    return (ids.join(agg, "user_id", "left")
            .select("user_id", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
                                 for c in ("longs", "shorts")]))


def account_counts(accounts: DataFrame, users: DataFrame) -> DataFrame:
    """Number of accounts per user (0 with none)."""
    agg = accounts.groupBy("user_id").agg(F.count(F.lit(1)).alias("accounts"))
    ids = users.select(F.col("id").alias("user_id"))
    return (ids.join(agg, "user_id", "left")
            .select("user_id", F.coalesce(F.col("accounts"), F.lit(0).cast("bigint"))
                    .alias("accounts")))
