"""Stream forms of ingest (S1), the daily summary (S2) and the ledger (S3).

All three read a change feed of files (schema of ``events``) with
``readStream`` and check it with the same functions as batch ingest. Every
micro-batch writes only folders named by its batch id, with mode overwrite, so
a batch that is run again after a failure replaces its own output and can harm
no other; a batch without rows writes nothing that readers need.

The live ledger is a log of checked changes and an aggregate over it that does
not depend on the order in which files arrive. ``compact`` folds the log into a
new snapshot version, publishes it with a pointer row, and never changes an old
one; it keeps each key's last delete and all that came after it, which is all
that any later (even late) change can still need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pnlbook.operators.changes import KEY, TRADE_PAYLOAD, checked_changes, live_rows
from pnlbook.operators.summaries import daily_summary
from pnlbook.schemas import EVENTS, TOTAL
from pnlbook.sources.fixtures import changes_from_events

LOG_SCHEMA = ("seq BIGINT, op STRING, user_id INT, id BIGINT, ts TIMESTAMP_NTZ, date DATE, type STRING, entry_price DECIMAL(18,4), "
              "exit_price DECIMAL(18,4), position_size DECIMAL(18,4), pnl DECIMAL(18,4), grade STRING, notes STRING, mental STRING, "
              "initial_risk DECIMAL(18,4), account_ids ARRAY<INT>, ok BOOLEAN, bucket INT")
# Key buckets of the log. A micro-batch reads only the buckets its keys fall in;
# size them to about log bytes / 256 MiB.
BUCKETS = 16
SUMMARY = ["trade_count", "daily_pnl", "wins", "losses", "longs", "shorts"]


def change_stream(spark: SparkSession, source_dir: str) -> DataFrame:
    return changes_from_events(spark.readStream.schema(EVENTS).parquet(source_dir))


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one while nothing has been written at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def run_ingest(spark: SparkSession, source_dir: str, users: DataFrame, sink: str, rejects: str, checkpoint: str):
    """Entries of the feed (inserts and updates) checked and priced; clean
    rows to ``sink``, refused ones with their reasons to ``rejects``."""
    changes = change_stream(spark, source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = checked_changes(batch.filter("op <> 'D'"), users).persist()
        try:
            checked.filter("ok").drop("ok", "reasons").write.mode("overwrite").parquet(_batch_dir(sink, batch_id))
            checked.filter("not ok").select("seq", "reasons").write.mode("overwrite").parquet(_batch_dir(rejects, batch_id))
        finally:
            checked.unpersist()

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def key_bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col("user_id").cast("bigint"), F.col("id")), F.lit(buckets)).cast("int")


def append_changes(batch: DataFrame, users: DataFrame | None, root: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """S3: one batch of changes into the log, checked, by key bucket."""
    write_log(checked_changes(batch, users).filter("ok").drop("reasons"), root, batch_id, buckets)


def write_log(checked: DataFrame, root: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Checked changes into the log; a purge (op P) into the purge list as well."""
    checked.where("op = 'P'").select("user_id", "seq").write.mode("overwrite").parquet(_batch_dir(f"{root}/purges", batch_id))
    rows = checked.where("op <> 'P'").withColumn("bucket", key_bucket(buckets))
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "user_id", "id")
     .write.mode("overwrite").partitionBy("bucket").parquet(_batch_dir(f"{root}/log", batch_id)))


def _version(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The last published snapshot (it holds all batches up to that id), or -1;
    if wanted, the last one that holds no batch from ``before`` on, so that a batch that
    is run again after a compaction still finds the state it began with."""
    pointers = _read(spark, f"{root}/pointers", "version BIGINT")
    if before is not None:
        pointers = pointers.filter(F.col("version") < before)
    last = pointers.agg(F.max("version")).first()[0]
    return -1 if last is None else last


def read_purges(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(user_id, purged): the last purge of each purged user, by seq."""
    rows = _read(spark, f"{root}/purges", "user_id INT, seq BIGINT, batch_id BIGINT")
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    return rows.groupBy("user_id").agg(F.max("seq").alias("purged"))


def unpurged(rows: DataFrame, purges: DataFrame) -> DataFrame:
    """Without the changes that a purge of their user has wiped out, whenever
    they arrive; what has a greater seq than the purge counts anew."""
    marked = rows.join(purges, "user_id", "left")
    return marked.filter(F.col("purged").isNull() | (F.col("seq") > F.col("purged"))).drop("purged")


def read_log(spark: SparkSession, root: str, before: int | None = None, touched: list[int] | None = None) -> DataFrame:
    """The checked changes that count: the last snapshot and the batches after
    it, if wanted only those before a batch id or of some buckets. Purges are not applied."""
    version = _version(spark, root, before)
    log = _read(spark, f"{root}/log", LOG_SCHEMA + ", batch_id BIGINT").filter(F.col("batch_id") > version)
    if before is not None:
        log = log.filter(F.col("batch_id") < before)
    log = log.drop("batch_id")
    if version >= 0:
        log = log.unionByName(_read(spark, f"{root}/snapshots/version={version}", LOG_SCHEMA))
    return log.filter(F.col("bucket").isin(touched)) if touched is not None else log


def read_ledger_state(spark: SparkSession, root: str) -> DataFrame:
    """The live rows of the stream ledger."""
    return live_rows(unpurged(read_log(spark, root), read_purges(spark, root)))


def compact(spark: SparkSession, root: str) -> int:
    """Folds snapshot and log into a new snapshot and publishes it; returns its
    version. A crash before the pointer is written leaves the old one in force."""
    ids = _read(spark, f"{root}/log", LOG_SCHEMA + ", batch_id BIGINT").agg(F.max("batch_id")).first()[0]
    if ids is None or ids <= _version(spark, root):
        return _version(spark, root)
    rows = unpurged(read_log(spark, root, before=ids + 1), read_purges(spark, root, before=ids + 1))
    last_d = rows.filter("op = 'D'").groupBy(*KEY).agg(F.max("seq").alias("last_d"))
    kept = rows.join(last_d, KEY, "left").filter(F.col("last_d").isNull() | (F.col("seq") >= F.col("last_d"))).drop("last_d")
    (kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/snapshots/version={ids}"))
    spark.createDataFrame([(ids,)], "version BIGINT").write.mode("append").parquet(f"{root}/pointers")
    return ids


def run_ledger(spark: SparkSession, source_dir: str, users: DataFrame | None, root: str, checkpoint: str, buckets: int = BUCKETS):
    """S3: the live ledger as a log under ``root``; read it with ``read_ledger_state``."""
    changes = change_stream(spark, source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch, users, root, batch_id, buckets)

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# Up to so many users of a batch are looked up by an IN list that the scan can push down.
LOOKUP_USERS = 1_000


def for_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of some users (user_id): a pushed-down IN list while they are few
    (files and row groups without them are skipped), a semi join beyond."""
    few = [r[0] for r in users.select("user_id").distinct().limit(LOOKUP_USERS + 1).collect()]
    if len(few) <= LOOKUP_USERS:
        return rows.where(F.col("user_id").isin(few)) if few else rows.where(F.lit(False))
    return rows.join(users.select("user_id").distinct(), "user_id", "left_semi")


def state_changes(spark: SparkSession, root: str, batch_id: int, payload: list[str] = TRADE_PAYLOAD) -> DataFrame:
    """The live rows of the keys that a logged batch touches, before it (``sign`` -1) and after it (1):
    its own keys, and all keys of the users it purges. Both states come from one pass over
    the touched users' changes, with the columns of ``payload``; see ``live_rows``."""
    columns = ["seq", "op", "ts", *KEY, *(c for c in payload if c != "ts")]
    new = _read(spark, _batch_dir(f"{root}/log", batch_id), LOG_SCHEMA).where("ok").select(*columns, F.lit(False).alias("was"))
    purges = _read(spark, f"{root}/purges", "user_id INT, seq BIGINT, batch_id BIGINT").where(F.col("batch_id") <= batch_id)
    earlier = F.col("batch_id") < batch_id
    wipes = purges.groupBy("user_id").agg(F.max(F.when(earlier, F.col("seq"))).alias("purged_was"), F.max("seq").alias("purged_now"), F.max(~earlier).alias("wiped"))
    users = new.select("user_id").unionByName(wipes.where("wiped").select("user_id"))
    old = for_users(read_log(spark, root, batch_id).where("ok").select(*columns, F.lit(True).alias("was")), users)
    rows = old.unionByName(new)
    is_d = F.when(F.col("op") == "D", F.col("seq"))
    keys = rows.groupBy(*KEY).agg(F.max(F.when(F.col("was"), is_d)).alias("d_was"), F.max(is_d).alias("d_now"), F.max(~F.col("was")).alias("fresh"))
    rows = rows.where("op <> 'D'").join(keys, KEY, "left").join(wipes, "user_id", "left").where("not was or fresh or wiped")
    counts = {t: F.greatest(f"d_{t}", f"purged_{t}").isNull() | (F.col("seq") > F.greatest(f"d_{t}", f"purged_{t}")) for t in ("was", "now")}
    rows = rows.withColumns({"in_was": F.col("was") & counts["was"], "in_now": counts["now"]}).where("in_was or in_now")
    whole = F.struct("seq", "ts", *payload)
    aggs = []
    for t in ("was", "now"):
        ins, upd = (F.when(F.col(f"in_{t}") & (F.col("op") == op), F.col("seq")) for op in "IU")
        aggs += [F.min(ins).alias(f"born_{t}"), F.min_by(whole, ins).alias(f"first_{t}"), F.max_by(whole, upd).alias(f"last_{t}")]

    def state(t: str, sign: int):
        row = F.when(F.col(f"last_{t}.seq") > F.col(f"born_{t}"), F.col(f"last_{t}")).otherwise(F.col(f"first_{t}"))
        return F.struct(F.lit(sign).alias("sign"), row.alias("row"), F.col(f"born_{t}").alias("born"), F.col(f"first_{t}.ts").alias("created_at"))

    both = rows.groupBy(*KEY).agg(*aggs).select(*KEY, F.inline(F.array(state("was", -1), state("now", 1)))).where("born is not null")
    return both.select(*KEY, *(F.col(f"row.{c}") for c in payload), "born", "row.seq", "created_at", "sign")


def states(spark: SparkSession, root: str, batch_id: int, payload: list[str] = TRADE_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """The two states of ``state_changes``, each on its own."""
    both = state_changes(spark, root, batch_id, payload)
    return both.where("sign < 0").drop("sign"), both.where("sign > 0").drop("sign")


def daily_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed in E1 between two states of the same keys: sums to add per (user, date)."""
    sides = [daily_summary(t.select("user_id", "date", "pnl", "type")).withColumns({c: F.col(c) * sign for c in SUMMARY})
             for t, sign in ((after, 1), (before, -1))]
    both = sides[0].unionByName(sides[1]).groupBy("user_id", "date").agg(*(F.sum(c).alias(c) for c in SUMMARY))
    both = both.filter(" or ".join(f"{c} <> 0" for c in SUMMARY))
    return both.select("user_id", "date", *(F.col(c).cast(TOTAL if c == "daily_pnl" else "bigint").alias(c) for c in SUMMARY))


DELTA_SCHEMA = "user_id INT, date DATE, " + ", ".join(f"{c} {'DECIMAL(28,4)' if c == 'daily_pnl' else 'BIGINT'}" for c in SUMMARY)


def run_daily_summary(spark: SparkSession, source_dir: str, users: DataFrame | None, root: str, sink: str, checkpoint: str,
                      buckets: int = BUCKETS):
    """The live daily summary (E1 of the live ledger). A created, updated or
    deleted trade adjusts its day: each batch writes the differences of the days
    of its own keys, however late they come."""
    changes = change_stream(spark, source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch, users, root, batch_id, buckets)
        before, after = states(spark, root, batch_id, ["date", "type", "pnl"])
        daily_deltas(before, after).write.mode("overwrite").parquet(_batch_dir(sink, batch_id))

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_daily_summary(spark: SparkSession, sink: str) -> DataFrame:
    """The sum of all differences: days that have trades now."""
    sums = _read(spark, sink, DELTA_SCHEMA).groupBy("user_id", "date").agg(*(F.sum(c).alias(c) for c in SUMMARY))
    typed = [F.col(c).cast(TOTAL if c == "daily_pnl" else "bigint").alias(c) for c in SUMMARY]
    return sums.filter("trade_count > 0").select("user_id", "date", *typed)
