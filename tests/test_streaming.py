"""Streams over files, with restarts from the checkpoint, end equal to the batch result."""

import datetime as dt
import os

from pyspark.sql import functions as F

from pnlbook.operators import changes, summaries
from pnlbook.plans.context import Journal
from pnlbook.schemas import EVENTS
from pnlbook.streaming import feed, jobs
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def test_stream_ledger_and_summary_equal_batch(spark, tmp_dir):
    """Slices in reverse order of seq: late changes count like any other."""
    j = Journal(spark, SF_SMALL)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("turn", -F.col("event_id"))
    src, root, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "state", "sink", "ck"))

    def run(_i):
        jobs.run_daily_summary(spark, src, j.users, root, sink, ck, buckets=4).awaitTermination()

    feed.feed_in_slices(ev, "turn", 3, src, run)
    want = changes.live_ledger(j.trade_changes, j.users)
    assert _rows(jobs.read_ledger_state(spark, root)) == _rows(want)
    daily = jobs.read_daily_summary(spark, sink)
    assert _rows(daily) == _rows(summaries.daily_summary(want).select(daily.columns))


def test_created_then_deleted_trade_leaves_no_day(spark, tmp_dir):
    src, root, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "state", "sink", "ck"))
    t = dt.datetime(2024, 3, 10, 23, 30)
    first = [(10, t, 1, "signup", 5.0, None), (11, t, 1, "signup", 7.0, None)]
    second = [(20, t + dt.timedelta(days=9), 1, "error", 0.0, None)]            # deletes key 10
    for rows in (first, second, []):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(src)
        jobs.run_daily_summary(spark, src, None, root, sink, ck).awaitTermination()
    got = [(r.date, r.trade_count, float(r.daily_pnl)) for r in jobs.read_daily_summary(spark, sink).collect()]
    assert got == [(dt.date(2024, 3, 10), 1, -7.0)]


def test_ledger_stream_starts_with_an_empty_batch(spark, tmp_dir):
    src, root, ck = (os.path.join(tmp_dir, x) for x in ("src", "ledger", "ck"))
    assert jobs.read_ledger_state(spark, root).count() == 0
    for rows in ([], [(10, dt.datetime(2024, 3, 1), 1, "signup", 5.0, None)]):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(src)
        jobs.run_ledger(spark, src, None, root, ck).awaitTermination()
    assert [r.id for r in jobs.read_ledger_state(spark, root).collect()] == [10]


def test_stream_ingest_writes_rejects(spark, tmp_dir):
    src, sink, rej, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "rej", "ck"))
    rows = [(1, dt.datetime(2024, 3, 1), 1, "click", 5.0, None), (2, None, 1, "click", 1.0, None), (53, dt.datetime(2024, 3, 1), 1, "click", 1.0, None),
            (4, dt.datetime(2024, 3, 1), 26, "click", 1.0, None), (5, dt.datetime(2024, 3, 1), 1, "error", 1.0, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(src)
    users = spark.createDataFrame([(1,)], "id INT")
    for _ in range(2):              # a second run with nothing new leaves the sinks as they are
        jobs.run_ingest(spark, src, users, sink, rej, ck).awaitTermination()
        assert [r.seq for r in spark.read.parquet(sink).collect()] == [1]
        r = sorted((x.seq, x.reasons) for x in spark.read.parquet(rej).collect())
        assert r == [(2, "missing_date"), (4, "unknown_user"), (53, "missing_entry_price,missing_exit_price")]


def test_days_follow_ts_date_in_any_session_zone(spark, tmp_dir):
    src, root, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "state", "sink", "ck"))
    late_evening = dt.datetime(2024, 3, 10, 23, 30)
    rows = [(10, late_evening, 1, "signup", 5.0, None), (11, late_evening + dt.timedelta(hours=1), 1, "signup", 1.0, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(src)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        jobs.run_daily_summary(spark, src, None, root, sink, ck).awaitTermination()
        got = {r.date: r.trade_count for r in jobs.read_daily_summary(spark, sink).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {dt.date(2024, 3, 10): 1, dt.date(2024, 3, 11): 1}
