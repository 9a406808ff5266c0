"""Smaller operators: lookups, orders, load projection, the batch ingest job."""

import datetime as dt
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from pnlbook.operators import filters, ingest, ordering
from pnlbook.plans.batch import ingest_to_ledger
from pnlbook.plans.context import Journal
from pnlbook.sources import ledger
from tests.conftest import SF_SMALL


def test_by_id_is_scoped_to_user(spark):
    t = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "id LONG, user_id INT")
    assert [tuple(r) for r in filters.by_id(t, 1, 5).collect()] == [(1, 5)]
    assert filters.by_id(t, 2, 6).count() == 0


def test_newest_first_is_total(spark):
    d = dt.date(2024, 1, 1)
    ts = dt.datetime(2024, 1, 1, 9)
    t = spark.createDataFrame([(1, d, ts), (2, d, ts), (3, d + dt.timedelta(1), ts),
                               (4, d, ts + dt.timedelta(hours=1))],
                              "id LONG, date DATE, created_at TIMESTAMP_NTZ")
    assert [r.id for r in ordering.newest_first(t).collect()] == [3, 4, 2, 1]
    assert [r.id for r in ordering.chart_order(t.drop("created_at")).collect()][-1] == 3


def test_load_projection_text_fields(spark):
    df = spark.createDataFrame([("2024-06-03T22:00:00.000Z", "12.50"), ("2024-06-04", "x")],
                               "date STRING, pnl STRING")
    r = ingest.load_projection(df).collect()
    assert r[0].date == dt.date(2024, 6, 3) and r[0].pnl == D("12.5000") and r[1].pnl is None


def test_normalise_accounts(spark):
    df = spark.createDataFrame([(1, " main ", "prop", "12.5"), (2, "", "x", None), (3, None, "live", "zz"),
                                (4, "   ", "live", " 7.25usd"), (5, "b", "prop", "-.5")],
                               "id INT, name STRING, type STRING, size STRING")
    r = {x.id: x for x in ingest.normalise_accounts(df).collect()}
    assert (r[1].name, r[1].type, r[1].size, r[1].valid) == ("main", "prop", D("12.5000"), True)
    assert (r[2].type, r[2].size, r[2].valid) == ("live", D("0.0000"), False)
    assert not r[3].valid and r[3].size == D("0.0000")
    # a name of spaces passes the check and is stored trimmed (empty)
    assert (r[4].name, r[4].size, r[4].valid) == ("", D("7.2500"), True)
    assert r[5].size == D("-0.5000")


def test_ingest_job_writes_both_sinks(spark, tmp_dir):
    j = Journal(spark, SF_SMALL)
    out, rej = os.path.join(tmp_dir, "ledger"), os.path.join(tmp_dir, "rejects")
    ingest_to_ledger(j.raw_trades, j.users, out, rej)
    assert ledger.read_ledger(spark, out).count() == j.trades.count() == 1450
    r = spark.read.parquet(rej)
    assert r.count() == 50 and r.filter(F.col("reasons").contains("unknown_user")).count() == 16


def test_journal_over_written_ledger(spark, tmp_dir):
    from pnlbook.operators import summaries
    j = Journal(spark, SF_SMALL)
    out, rej = os.path.join(tmp_dir, "ledger"), os.path.join(tmp_dir, "rejects")
    ingest_to_ledger(j.raw_trades, j.users, out, rej)
    k = Journal(spark, SF_SMALL, ledger_path=out)
    a = summaries.monthly_summary(j.trades).collect()
    b = summaries.monthly_summary(k.trades).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_bounded_broadcast_respects_bound(spark):
    from pnlbook.plans.joins import BROADCAST_MAX_ROWS_CONF, bounded_broadcast
    big = spark.range(10).withColumnRenamed("id", "k")
    small = spark.range(3).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "BroadcastHashJoin" in plan(big.join(bounded_broadcast(small), "k"))
        spark.conf.set(BROADCAST_MAX_ROWS_CONF, "2")
        assert "BroadcastHashJoin" not in plan(big.join(bounded_broadcast(small), "k"))
    finally:
        spark.conf.unset(BROADCAST_MAX_ROWS_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_month_edges_and_open_ranges(spark):
    from pnlbook.operators import calendar_grid, stats
    assert filters.month_bounds("2024-12") == (dt.date(2024, 12, 1), dt.date(2024, 12, 31))
    assert filters.month_bounds("2024-02") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    t = spark.createDataFrame([(1, 1, dt.date(2024, 12, 31), "LONG", D("5")),
                               (2, 1, dt.date(2025, 1, 1), "SHORT", D("-2"))],
                              "id LONG, user_id INT, date DATE, type STRING, pnl DECIMAL(18,4)")
    users = spark.createDataFrame([(1, "a")], "id INT, username STRING")
    g = calendar_grid.calendar_grid(t, users, ["2024-12", "2025-01"])
    cells = {r.date: r for r in g.collect() if r.date is not None}
    assert len(cells) == 62 and cells[dt.date(2024, 12, 31)].day_class == "profit"
    assert cells[dt.date(2025, 1, 1)].pnl_sign == "neg"
    only_from = stats.api_stats(t, users, date_from="2025-01-01").collect()[0]
    assert (only_from.total, only_from.net_pnl, only_from.shorts) == (1, D("-2.0000"), 1)
    assert filters.trailing_days(t, "2025-01-01 00:00:00", None).count() == 2


def test_pnl_only_entries_from_text(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), "LONG", "12.5abc", " x "), (2, dt.date(2024, 1, 2), "SHORT", "-3", None),
                                (3, dt.date(2024, 1, 2), "LONG", "abc", None), (4, None, "LONG", "1", None)],
                               "seq LONG, date DATE, type STRING, pnl_input STRING, notes STRING")
    r = {x.seq: x for x in ingest.pnl_only_entries(df).collect()}
    assert sorted(r) == [1, 2]
    assert (r[1].exit_price, r[1].pnl, r[1].notes) == (D("112.5000"), D("12.5000"), "x")
    assert (r[2].exit_price, r[2].pnl) == (D("103.0000"), D("-3.0000"))
