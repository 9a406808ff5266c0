"""Plan shape: filters reach the scan, columns are pruned, every window has
partition keys (SURVEY §5.6)."""

import re

from pnlbook.plans.catalog import QUERIES
from pnlbook.operators import filters
from pnlbook.plans.context import Journal
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_is_pushed_to_the_scan(spark):
    t = filters.date_range(Journal(spark, SF_SMALL).trades, "1997-01-01", "1998-12-31")
    p = plan(t.select("id", "pnl"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p) or \
        "o_orderdate" in p.split("PushedFilters")[1]


def test_scans_read_only_needed_columns(spark):
    p = plan(QUERIES["monthly_summary"](spark, SF_SMALL))
    orders_schema = re.search(r"ReadSchema: struct<(o_[^>]*)>", p).group(1)
    assert "o_orderstatus" not in orders_schema and "o_comment" not in orders_schema


def test_no_window_without_partition_keys(spark):
    for name in ["equity_curve", "change_outcomes", "live_ledger", "equity_curve_90d"]:
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "SinglePartition" not in p, name
        for w in re.findall(r"Window \[[^\n]*", p):
            assert re.search(r"\], \[[^\]]+\], \[", w), w


def test_no_python_udf_in_catalogue(spark):
    for name, fn in QUERIES.items():
        if name.startswith("stream_") or name.startswith("ledger_"):
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_no_cartesian_or_nested_loop_join(spark):
    for name, fn in QUERIES.items():
        if name.startswith("stream_") or name in ("ledger_roundtrip", "ledger_append", "json_file_ingest"):
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_live_ledger_needs_no_window(spark):
    """The live state is grouped aggregates with partial aggregation; windows are for outcomes only."""
    p = plan(QUERIES["live_ledger"](spark, SF_SMALL))
    assert not re.search(r"Window \[", p) and "partial_min(" in p


def test_ingest_path_builds_no_reason_text(spark):
    p = plan(QUERIES["ingest_trades"](spark, SF_SMALL))
    assert "concat_ws" not in p
    # the PnL arithmetic is evaluated once, not copied into a pushed filter
    assert p.count("try_cast(round(") == 1


def test_sql_functions_push_the_same_filters(spark, tmp_dir):
    """A table function over a written ledger: folders pruned and filters in the scan as in the DataFrame form."""
    import os

    from pnlbook.operators import filters
    from pnlbook.plans import sql_api
    from pnlbook.sources import ledger
    path = os.path.join(tmp_dir, "ledger")
    ledger.write_ledger(Journal(spark, SF_SMALL).trades, path)
    j = Journal(spark, SF_SMALL, ledger_path=path)
    sql_api.register(j)
    sql = spark.sql("SELECT id FROM user_trades(7, DATE'1997-01-01', NULL, NULL)")
    df = filters.date_range(filters.by_user(j.trades.drop("month"), 7), "1997-01-01").select("id")
    pushed = lambda d: d._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("]")[0]
    assert sorted(pushed(sql).strip("[").split(", ")) == sorted(pushed(df).strip("[").split(", ")) and "EqualTo(user_id,7)" in pushed(sql)
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, df.collect()))
    one = spark.sql("SELECT id FROM user_trades(7, NULL, NULL, NULL) ORDER BY id LIMIT 1").first().id
    assert [r.id for r in spark.sql(f"SELECT id FROM user_trade(7, {one})").collect()] == [one]
    assert spark.sql("SELECT id FROM user_accounts(7)").count() == 3


def test_broadcast_is_bounded_by_files_rows_and_bytes(spark, monkeypatch):
    from pnlbook.plans import joins
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    users = Journal(spark, SF_SMALL).users
    assert hinted(joins.bounded_broadcast(users))
    monkeypatch.setattr(joins, "BROADCAST_MAX_FILE_BYTES", 0)
    assert hinted(joins.bounded_broadcast(users))                    # by count
    assert not hinted(joins.bounded_broadcast(users, max_rows=5))
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 100)
    assert not hinted(joins.bounded_broadcast(users))
