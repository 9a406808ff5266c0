"""Row filters (C1-C9). Each is a plain predicate on columns the parquet
scan can take as a pushed filter; date ranges are turned into plain date
bounds on the driver instead of expressions over ``date``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(v) -> dt.date:
    return v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v)[:10])


def _ts(v) -> dt.datetime:
    return v if isinstance(v, dt.datetime) else dt.datetime.fromisoformat(str(v))


def by_user(df: DataFrame, user_id: int) -> DataFrame:
    """C1."""
    return df.filter(F.col("user_id") == F.lit(user_id))


def date_range(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """From <= date <= to, each end optional. On a written ledger
    (with its ``month`` column) the bounds also go to the month folders."""
    by_month = "month" in df.columns
    if date_from is not None:
        d = _date(date_from)
        df = df.filter(F.col("date") >= F.lit(d))
        df = df.filter(F.col("month") >= d.strftime("%Y-%m")) if by_month else df
    if date_to is not None:
        d = _date(date_to)
        df = df.filter(F.col("date") <= F.lit(d))
        df = df.filter(F.col("month") <= d.strftime("%Y-%m")) if by_month else df
    return df


def by_account(df: DataFrame, account_id: int) -> DataFrame:
    """The account is in the trade's list."""
    return df.filter(F.array_contains(F.col("account_ids"), F.lit(account_id).cast("int")))


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    """'yyyy-MM' -> first and last day."""
    y, m = (int(x) for x in month.split("-"))
    first = dt.date(y, m, 1)
    nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
    return first, nxt - dt.timedelta(days=1)


def by_month(df: DataFrame, month: str) -> DataFrame:
    """C4: a plain date range, so it is pushed to the scan."""
    first, last = month_bounds(month)
    return date_range(df, first, last)


def trailing_cutoff(as_of, days: int) -> dt.date:
    """First date kept by a trailing range: date at midnight >= as_of - days."""
    cut = _ts(as_of) - dt.timedelta(days=days)
    d = cut.date()
    return d if cut.time() == dt.time(0) else d + dt.timedelta(days=1)


def trailing_days(df: DataFrame, as_of, days: int | None) -> DataFrame:
    """The last ``days`` days up to ``as_of`` (None = all). Dates after
    ``as_of`` stay in, as in the chart."""
    if days is None:
        return df
    return date_range(df, trailing_cutoff(as_of, days))


def one_day(df: DataFrame, day) -> DataFrame:
    """C6."""
    return date_range(df, day, day)


def by_id(df: DataFrame, trade_id: int, user_id: int) -> DataFrame:
    """One trade, scoped to its user."""
    return df.filter((F.col("id") == F.lit(trade_id)) & (F.col("user_id") == F.lit(user_id)))


def is_win(pnl: str = "pnl") -> Column:
    """C8."""
    return F.col(pnl) > 0


def is_loss(pnl: str = "pnl") -> Column:
    return F.col(pnl) < 0


def is_side(side: str) -> Column:
    return F.col("type") == side
