"""The dashboard for one account at a time, for all accounts in one pass.

Choosing an account reloads every figure from that account's trades. Here each
trade is dealt to its accounts once and the account takes the user's place, so
curve, calendar, scores and labels are the same functions with another key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def account_trades(trades: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each trade once for each of its accounts, keyed by account in ``user_id``.
    Ids that name no account of the trade's user drop out."""
    pairs = trades.select("user_id", "date", "type", "pnl", F.explode(F.array_distinct("account_ids")).alias("account_id"))
    own = accounts.select(F.col("id").cast("int").alias("account_id"), "user_id")
    return (pairs.join(own, ["account_id", "user_id"], "left_semi")
            .select(F.col("account_id").alias("user_id"), "date", "type", "pnl"))


def per_account(trades: DataFrame, accounts: DataFrame, figure: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``figure(trades, users)`` by account: its ``user_id`` is the ``account_id``."""
    keys = accounts.select(F.col("id").cast("int").alias("id"))
    return figure(account_trades(trades, accounts), keys).withColumnRenamed("user_id", "account_id")
