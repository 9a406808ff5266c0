"""The live dashboard: every figure current after each batch of changes.

One stream job (``run_live``) appends checked changes to the ledger's log (S3) and
derives from each batch the rows it takes away and adds (``jobs.state_changes``). From
these come signed sums per (user, account, day); all other tables follow from
those sums alone:

    days, months    signed sums to add up (E1, E3-E6); ratios are made on read
    best            each user's greatest day sums with a floor for all others (E7, G1, G2)
    curve_days      running sums inside a month; curve_months: what came before it (F1, F5)
    outcomes        what each change did (I4), corrected where a late change alters it
    closed          a day's final figures, once, when the watermark has passed it;
    corrections     what later changes add to a closed day (S2)

Every table is a folder of batches, each written with mode overwrite, so a
batch that is run again replaces its own output. ``fold_sums`` merges the sums of finished
batches into a base version; a rerun of an older batch still reads the base before
it. Late and unordered changes, updates, deletes and purges are all the same here:
differences between two states of the touched keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pnlbook.operators import scores, stats
from pnlbook.operators.changes import ACCOUNT_PAYLOAD, KEY, checked_accounts, checked_changes, fold_outcomes, live_rows
from pnlbook.operators.filters import date_range
from pnlbook.schemas import TOTAL
from pnlbook.streaming import jobs
from pnlbook.streaming.jobs import _batch_dir, _read, for_users

SUMS = [*stats.COUNTS, *stats.SUMS]
_SUM_TYPES = ", ".join(f"{c} {'BIGINT' if c in stats.COUNTS else 'DECIMAL(28,4)'}" for c in SUMS)
# table -> its key columns; all are sums
KEYS = {"days": {"user_id": "INT", "account_id": "INT", "date": "DATE"}, "months": {"user_id": "INT", "account_id": "INT", "first": "DATE"}}
HISTORY = "seq BIGINT, op STRING, user_id INT, id BIGINT, ok BOOLEAN"
OUTCOMES = "seq BIGINT, op STRING, user_id INT, id BIGINT, outcome STRING"
BEST = "user_id INT, tops ARRAY<STRUCT<pnl: DECIMAL(28,4), date: DATE>>, floor DECIMAL(28,4)"
CURVE_DAYS = "user_id INT, first DATE, date DATE, daily_pnl DECIMAL(28,4), in_month DECIMAL(28,4)"
CURVE_MONTHS = "user_id INT, first DATE, before DECIMAL(28,4)"

TOPS = 16               # day sums kept for each user; more are fetched from ``days`` when all are gone
DELAY_DAYS = 7          # a day is closed when changes of a time so much later have come


def _write(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_batch_dir(f"{root}/{table}", batch_id))


def _batches(spark: SparkSession, root: str, table: str, schema: str, before: int) -> DataFrame:
    return _read(spark, f"{root}/{table}", f"{schema}, batch_id BIGINT").where(F.col("batch_id") < before)


def _typed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).cast("bigint" if c in stats.COUNTS else TOTAL).alias(c) for c in SUMS))


# ---- sums ----------------------------------------------------------------------

DAY_COLUMNS = ["date", "type", "pnl", "account_ids"]     # what the sums need of a trade


def day_sums(rows: DataFrame, *more: str) -> DataFrame:
    """Base aggregates per (user, account, day); account NULL = all trades."""
    every = F.concat(F.array_distinct(F.coalesce("account_ids", F.array().cast("array<int>"))), F.array(F.lit(None).cast("int")))
    return rows.select("user_id", "date", "type", "pnl", *more, F.explode(every).alias("account_id")).groupBy(*KEYS["days"], *more).agg(*stats.base_aggs())


def added(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of sums, without keys where nothing is left."""
    out = _typed(df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS)), keys)
    return out.where(" or ".join(f"{c} <> 0" for c in SUMS))


def day_deltas(changed: DataFrame) -> DataFrame:
    """What a batch changed (``jobs.state_changes``), as signed sums per (user, account, day)."""
    signed = {c: F.when(F.col("sign") < 0, -F.col(c)).otherwise(F.col(c)) for c in SUMS}
    return added(day_sums(changed, "sign").withColumns(signed), list(KEYS["days"]))


def read_sums(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """``days`` or ``months`` as they stand (before a batch): base version and later batches, not yet added up."""
    keys = KEYS[table]
    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + ", " + _SUM_TYPES
    before = 1 << 62 if before is None else before
    last = _read(spark, f"{root}/{table}_pointers", "version BIGINT").where(F.col("version") < before).agg(F.max("version")).first()[0]
    rows = _batches(spark, root, table, schema, before)
    if last is None:
        return rows.drop("batch_id")
    base = _read(spark, f"{root}/{table}_base/version={last}", schema)
    return rows.where(F.col("batch_id") > last).drop("batch_id").unionByName(base)


def fold_sums(spark: SparkSession, root: str) -> int:
    """Merges the finished batches of ``days`` and ``months`` into new base versions; the last of them."""
    done = _read(spark, f"{root}/done", "batch_id BIGINT").agg(F.max("batch_id")).first()[0]
    if done is None:
        return -1
    for table, keys in KEYS.items():
        rows = added(read_sums(spark, root, table, done + 1), list(keys))
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{root}/{table}_base/version={done}")
        spark.createDataFrame([(done,)], "version BIGINT").write.mode("append").parquet(f"{root}/{table}_pointers")
    return done


def read_days(spark: SparkSession, root: str) -> DataFrame:
    """Sums per (user, account, day) that has trades now."""
    return added(read_sums(spark, root, "days"), list(KEYS["days"])).where("total > 0")


def _all_accounts(df: DataFrame) -> DataFrame:
    return df.where(F.col("account_id").isNull()).drop("account_id")


def read_stat_card(spark: SparkSession, root: str, users: DataFrame) -> DataFrame:
    """E4 of the live ledger."""
    return stats.card_from_sums(added(_all_accounts(read_sums(spark, root, "months")), ["user_id"]), users)


def read_api_stats(spark: SparkSession, root: str, users: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """E3 of the live ledger over an optional range of days."""
    days = date_range(_all_accounts(read_sums(spark, root, "days")), date_from, date_to)
    return stats.api_from_sums(added(days, ["user_id"]), users)


def read_account_stats(spark: SparkSession, root: str, accounts: DataFrame, users: DataFrame) -> DataFrame:
    """E5 of the live ledger."""
    return stats.account_cards_from_sums(added(read_sums(spark, root, "months"), ["user_id", "account_id"]), accounts, users)


def read_month_stats(spark: SparkSession, root: str) -> DataFrame:
    """E6 of the live ledger."""
    sums = added(_all_accounts(read_sums(spark, root, "months")), ["user_id", "first"])
    return stats.month_cards_from_sums(sums.where("total > 0"))


# ---- outcomes --------------------------------------------------------------------

def write_outcomes(spark: SparkSession, root: str, batch_id: int) -> None:
    """I4 for the batch's changes, and again for earlier ones that come after them by seq.

    A key's outcomes depend on its own changes and its user's purges, so only the
    touched keys' (seq, op, ok) are read and folded; a purge stands as a delete of
    every key its user has."""
    new = _read(spark, _batch_dir(f"{root}/history", batch_id), HISTORY)
    purged = _read(spark, _batch_dir(f"{root}/purges", batch_id), "user_id INT, seq BIGINT")
    old = for_users(_batches(spark, root, "history", HISTORY, batch_id).drop("batch_id"), new.select("user_id").unionByName(purged.select("user_id")))
    from_key = new.groupBy(*KEY).agg(F.min("seq").alias("since"))
    from_user = purged.groupBy("user_id").agg(F.min("seq").alias("purge_since"))
    touched = (old.unionByName(new).select(*KEY).distinct().join(from_key, KEY, "left").join(from_user, "user_id", "left")
               .withColumn("since", F.least("since", "purge_since")).drop("purge_since").where("since is not null"))
    rows = old.unionByName(new).join(touched, KEY)
    purges = _batches(spark, root, "purges", "user_id INT, seq BIGINT", batch_id + 1).drop("batch_id").distinct()
    wiped = touched.join(purges, "user_id").select("seq", F.lit("D").alias("op"), *KEY, F.lit(True).alias("ok"), "since", F.lit(True).alias("purge"))
    folded = fold_outcomes(rows.withColumn("purge", F.lit(False)).unionByName(wiped), F.col("ok"), KEY)
    _write(folded.where(~F.col("purge") & (F.col("seq") >= F.col("since"))).select("seq", "op", *KEY, "outcome"), root, "outcomes", batch_id)


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """I4: what each change did, as known now."""
    rows = _read(spark, f"{root}/outcomes", f"{OUTCOMES}, batch_id BIGINT")
    return rows.groupBy("seq", "op").agg(F.max_by("outcome", "batch_id").alias("outcome"))


# ---- best day ----------------------------------------------------------------------

def write_best(spark: SparkSession, root: str, batch_id: int, deltas: DataFrame) -> None:
    """E7 under changes: a maximum that can be taken back.

    ``tops`` has the user's greatest day sums; no day outside it is above ``floor``
    (NULL: there is none outside). A changed day leaves the list and comes back with its
    new sum if that is at least the floor. Only when no entry is left while days
    outside exist are the user's days read again."""
    touched = _all_accounts(deltas).select("user_id", "date").distinct()
    sums = _all_accounts(for_users(read_sums(spark, root, "days", batch_id + 1), touched))
    entry = F.struct(F.col("net_pnl").alias("pnl"), F.col("date"))
    days = added(sums.join(touched, ["user_id", "date"], "left_semi"), ["user_id", "date"]).where("total > 0")
    fresh = days.groupBy("user_id").agg(F.collect_list(entry).alias("fresh"))              # at most one entry for each day
    gone = touched.groupBy("user_id").agg(F.collect_set("date").alias("gone"))
    last = (for_users(_batches(spark, root, "best", BEST, batch_id), touched)
            .groupBy("user_id").agg(F.max_by(F.struct("tops", "floor"), "batch_id").alias("was")).select("user_id", "was.*"))
    none = F.array().cast("array<struct<pnl:decimal(28,4),date:date>>")
    rows = gone.join(last, "user_id", "left").join(fresh, "user_id", "left")
    kept = F.filter(F.coalesce("tops", none), lambda t: ~F.array_contains("gone", t["date"]))
    rows = rows.select("user_id", "floor", F.sort_array(F.concat(kept, F.coalesce("fresh", none)), asc=False).alias("entries"))
    sure = F.filter("entries", lambda t: F.col("floor").isNull() | (t["pnl"] >= F.col("floor")))
    rows = rows.select("user_id", "floor", F.slice(sure, 1, TOPS).alias("tops"), F.get(F.slice("entries", F.size(F.slice(sure, 1, TOPS)) + 1, 1), 0)["pnl"].alias("next"))
    rows = rows.select("user_id", "tops", F.greatest("floor", "next").alias("floor")).persist()
    try:
        out = rows.where((F.size("tops") > 0) | F.col("floor").isNull())
        empty = rows.where((F.size("tops") == 0) & F.col("floor").isNotNull()).select("user_id")
        if not empty.isEmpty():
            again = added(_all_accounts(read_sums(spark, root, "days", batch_id + 1)).join(empty, "user_id", "left_semi"), ["user_id", "date"]).where("total > 0")
            ordered = again.groupBy("user_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))
            refilled = empty.join(ordered, "user_id", "left").withColumn("entries", F.coalesce("entries", none))
            out = out.unionByName(refilled.select("user_id", F.slice("entries", 1, TOPS).alias("tops"), F.get("entries", TOPS)["pnl"].alias("floor")))
        _write(out, root, "best", batch_id)
    finally:
        rows.unpersist()


def read_best_day(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, _max): the greatest daily sum of each user with trades."""
    rows = _read(spark, f"{root}/best", f"{BEST}, batch_id BIGINT").groupBy("user_id").agg(F.max_by("tops", "batch_id").alias("tops"))
    return rows.where(F.size("tops") > 0).select("user_id", F.get("tops", 0)["pnl"].alias("_max"))


def read_consistency(spark: SparkSession, root: str, users: DataFrame) -> DataFrame:
    """G1 + G2 of the live ledger."""
    net = added(_all_accounts(read_sums(spark, root, "months")), ["user_id"]).select("user_id", F.col("net_pnl").alias("net"))
    return scores.consistency_from_best(net.join(read_best_day(spark, root), "user_id"), users)


# ---- curve -------------------------------------------------------------------------

def write_curve(spark: SparkSession, root: str, batch_id: int, deltas: DataFrame) -> None:
    """F1 in two levels: the touched months' days get new running sums, and only the
    offsets of the touched users' months from the first touched one on are written."""
    touched = _all_accounts(deltas).select("user_id", F.trunc("date", "month").alias("first")).distinct()
    sums = _all_accounts(for_users(read_sums(spark, root, "days", batch_id + 1), touched)).withColumn("first", F.trunc("date", "month"))
    days = added(sums.join(touched, ["user_id", "first"], "left_semi"), ["user_id", "first", "date"]).where("total > 0")
    inside = Window.partitionBy("user_id", "first").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)         # at most 31 rows
    running = days.select("user_id", "first", "date", F.col("net_pnl").alias("daily_pnl"), F.sum("net_pnl").over(inside).cast(TOTAL).alias("in_month"))
    # a month without days left gets one row without a date
    _write(touched.join(running, ["user_id", "first"], "left").select("user_id", "first", "date", "daily_pnl", "in_month"), root, "curve_days", batch_id)
    since = touched.groupBy("user_id").agg(F.min("first").alias("since"))
    months = added(_all_accounts(for_users(read_sums(spark, root, "months", batch_id + 1), touched)).join(since.select("user_id"), "user_id", "left_semi"), ["user_id", "first"])
    earlier = Window.partitionBy("user_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)               # one row for each month
    before = F.coalesce(F.sum("net_pnl").over(earlier), F.lit(0)).cast(TOTAL)
    offsets = months.select("user_id", "first", before.alias("before")).join(since, "user_id").where("first >= since")
    _write(offsets.select("user_id", "first", "before"), root, "curve_months", batch_id)


def read_curve(spark: SparkSession, root: str) -> DataFrame:
    """F1 of the live ledger: the latest rows of each month and what came before it."""
    def latest(table: str, schema: str) -> DataFrame:
        rows = _read(spark, f"{root}/{table}", f"{schema}, batch_id BIGINT")
        newest = rows.groupBy("user_id", "first").agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, ["user_id", "first", "batch_id"]).drop("batch_id")

    days = latest("curve_days", CURVE_DAYS).where(F.col("date").isNotNull())
    return days.join(latest("curve_months", CURVE_MONTHS), ["user_id", "first"]).select(
        "user_id", "date", "daily_pnl", F.round(F.col("before") + F.col("in_month"), 2).cast(TOTAL).alias("cum_pnl"))


# ---- closed days -----------------------------------------------------------------------

def write_closed(spark: SparkSession, root: str, batch_id: int, deltas: DataFrame, delay_days: int) -> None:
    """S2 with closed days: the watermark is the latest time of any change less the
    delay. Days it passes are written once with their figures so far; what
    a batch changes on days that were closed before goes to ``corrections``."""
    batch_log = _read(spark, _batch_dir(f"{root}/log", batch_id), jobs.LOG_SCHEMA)
    was = _batches(spark, root, "marks", "closed_to DATE", batch_id).agg(F.max("closed_to")).first()[0]
    seen = batch_log.agg(F.date_sub(F.max(F.col("ts").cast("date")), delay_days)).first()[0]
    now = max((d for d in (was, seen) if d is not None), default=None)
    spark.createDataFrame([(now,)], "closed_to DATE").write.mode("overwrite").parquet(_batch_dir(f"{root}/marks", batch_id))
    mine = _all_accounts(deltas)
    late = mine.where(F.col("date") < F.lit(was)) if was else mine.where(F.lit(False))
    _write(_typed(late, ["user_id", "date"]), root, "corrections", batch_id)
    days = _all_accounts(read_sums(spark, root, "days", batch_id + 1))
    passed = days.where(F.col("date") < F.lit(now)) if now else days.where(F.lit(False))
    if was:
        passed = passed.where(F.col("date") >= F.lit(was))
    _write(added(passed, ["user_id", "date"]).where("total > 0"), root, "closed", batch_id)


def read_closed(spark: SparkSession, root: str) -> DataFrame:
    """Closed days with their corrections added."""
    day = f"user_id INT, date DATE, {_SUM_TYPES}"
    both = _read(spark, f"{root}/closed", day).unionByName(_read(spark, f"{root}/corrections", day))
    return added(both, ["user_id", "date"]).where("total > 0")


def read_open(spark: SparkSession, root: str) -> DataFrame:
    """The days that the watermark has not passed."""
    mark = _read(spark, f"{root}/marks", "closed_to DATE").agg(F.max("closed_to")).first()[0]
    days = _all_accounts(read_days(spark, root))
    return days.where(F.col("date") >= F.lit(mark)) if mark else days


# ---- accounts ----------------------------------------------------------------------------

ACCOUNT_LOG = "seq BIGINT, op STRING, user_id BIGINT, id BIGINT, ts TIMESTAMP_NTZ, name STRING, type STRING, size DECIMAL(18,4), ok BOOLEAN"


def run_accounts(changes: DataFrame, root: str, checkpoint: str):
    """I5 on a stream: checked account changes as a log; read it with ``read_accounts``
    (the accounts) and ``read_account_outcomes`` (what each change did)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _write(checked_accounts(batch), root, "accounts", batch_id)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_accounts(spark: SparkSession, root: str) -> DataFrame:
    return live_rows(_read(spark, f"{root}/accounts", ACCOUNT_LOG), ACCOUNT_PAYLOAD)


def read_account_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return fold_outcomes(_read(spark, f"{root}/accounts", ACCOUNT_LOG), F.col("ok"), KEY).select("seq", "op", "outcome")


# ---- the job -----------------------------------------------------------------------------

def write_batch(batch: DataFrame, batch_id: int, users: DataFrame | None, root: str, buckets: int = jobs.BUCKETS, delay_days: int = DELAY_DAYS) -> None:
    """One batch of changes into the log and all live tables; may be run again."""
    spark = batch.sparkSession
    checked = checked_changes(batch, users).persist()
    try:
        jobs.write_log(checked.filter("ok").drop("reasons"), root, batch_id, buckets)
        history = checked.where("op <> 'P'").select("seq", "op", *KEY, "ok")
        _write(history.repartition(F.col("user_id")).sortWithinPartitions("user_id", "id", "seq"), root, "history", batch_id)
    finally:
        checked.unpersist()
    write_outcomes(spark, root, batch_id)
    keys = KEYS["days"]
    _write(day_deltas(jobs.state_changes(spark, root, batch_id, DAY_COLUMNS)).sortWithinPartitions("user_id", "date"), root, "days", batch_id)
    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + ", " + _SUM_TYPES
    deltas = _read(spark, _batch_dir(f"{root}/days", batch_id), schema)
    _write(added(deltas.withColumn("first", F.trunc("date", "month")), list(KEYS["months"])), root, "months", batch_id)
    write_best(spark, root, batch_id, deltas)
    write_curve(spark, root, batch_id, deltas)
    write_closed(spark, root, batch_id, deltas, delay_days)
    spark.createDataFrame([(batch_id,)], "done BIGINT").write.mode("overwrite").parquet(_batch_dir(f"{root}/done", batch_id))


def run_live(changes: DataFrame, users: DataFrame | None, root: str, checkpoint: str, buckets: int = jobs.BUCKETS, delay_days: int = DELAY_DAYS):
    """The live dashboard over a stream of changes; read it with the ``read_`` functions."""
    return (changes.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, users, root, buckets, delay_days))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


