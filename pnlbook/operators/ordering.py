"""Orders (D1-D3). A global orderBy is a range-partitioned sort (sampled
bounds, so a hot key does not land in one task); the ordered outputs here
are the trade table and the chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_first(df: DataFrame) -> DataFrame:
    """Date DESC, created_at DESC; id makes the order total. The order
    is one user's; tables of several users come user by user."""
    keys = [F.col("user_id")] if "user_id" in df.columns else []
    keys.append(F.col("date").desc())
    if "created_at" in df.columns:
        keys.append(F.col("created_at").desc())
    keys.append(F.col("id").desc())
    return df.orderBy(*keys)


def with_position(df: DataFrame, newest: bool = True, user: str = "user_id") -> DataFrame:
    """``position`` (from 1) of each trade in its user's table: D1 / D2 (date DESC, created_at
    DESC, id DESC), or with ``newest`` false D3, the chart's order (date ASC; a day keeps D1's order).

    In two levels, so that a user's trades need not meet in one task: the
    place inside the day, and the number of trades on the days before it."""
    date = F.col("date").desc() if newest else F.col("date")
    day = Window.partitionBy(user, "date").orderBy(F.col("created_at").desc(), F.col("id").desc())
    days = df.groupBy(user, "date").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(user).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(user, "date", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (df.withColumn("inside", F.row_number().over(day)).join(before, [user, "date"])
            .withColumn("position", F.col("before") + F.col("inside")).drop("before", "inside"))


def oldest_first(accounts: DataFrame, user_id: int | None = None) -> DataFrame:
    """A2: accounts of one user, or of each, with their ``position`` by created_at (id
    for ties)."""
    df = accounts if user_id is None else accounts.filter(F.col("user_id") == F.lit(user_id))
    return df.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id")).cast("bigint"))


def chart_order(df: DataFrame) -> DataFrame:
    """D3: date ascending."""
    return df.orderBy("date")
