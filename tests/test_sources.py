"""JSON entries, the ledger on storage and its partition pruning."""

import json
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from pnlbook.operators import ingest
from pnlbook.plans.context import Journal
from pnlbook.sources import ledger
from tests.conftest import SF_SMALL


def test_json_entries_permissive(spark, tmp_dir):
    lines = [
        json.dumps({"id": 1, "user_id": 3, "date": "2024-06-03T00:00:00.000Z", "type": "LONG",
                    "entry_price": 100, "exit_price": "101.5", "position_size": "", "notes": None}),
        json.dumps({"id": 2, "user_id": 3, "date": "2024-06-04", "type": "SHORT",
                    "entry_price": "abc", "exit_price": 99}),
        "{not json",
    ]
    path = os.path.join(tmp_dir, "entries.json")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    e = ledger.read_entries(spark, path)
    rows = e.orderBy(F.col("id").asc_nulls_first()).collect()
    assert len(rows) == 3
    rows = [*rows[1:], rows[0]]
    assert rows[0].exit_price == D("101.5000") and rows[0].position_size is None
    assert str(rows[0].date) == "2024-06-03"
    assert rows[1].entry_price is None
    bad = next(r for r in rows if r.id is None)
    assert bad.problems & ledger.BAD_JSON and bad.raw == "{not json" and not rows[0].problems
    users = spark.createDataFrame([(3, "x"), (3, "x")], "id INT, username STRING")
    t = ingest.ingest(e, users).collect()
    assert [(r.id, r.pnl, r.position_size) for r in t] == [(1, D("1.5000"), D("1.0000"))]


def test_ledger_roundtrip_and_month_pruning(spark, tmp_dir):
    trades = Journal(spark, SF_SMALL).trades
    path = os.path.join(tmp_dir, "ledger")
    ledger.write_ledger(trades, path)
    assert any(d.startswith("month=") for d in os.listdir(path))
    back = ledger.read_ledger(spark, path, "1998-06-01", "1998-06-30")
    p = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in p and "1998-06" in p
    want = trades.filter(F.col("date").between("1998-06-01", "1998-06-30")).count()
    assert back.count() == want > 0
    got = back.drop("month").select(*trades.columns)
    assert got.exceptAll(trades.filter(F.col("date").between("1998-06-01", "1998-06-30"))).count() == 0


def test_json_faults_change_only_their_own_entry(spark):
    ok = {"id": 1, "user_id": "3", "date": "2024-06-03", "type": "LONG", "entry_price": 1, "exit_price": 2}
    sent = [ok, ok | {"id": 2, "date": "31/12/2024"}, ok | {"id": 3, "position_size": "abc"},
            ok | {"id": 4, "position_size": "1e30"}, ok | {"id": 5, "initial_risk": "12.5R"}, ok | {"id": 6, "user_id": {"x": 1}},
            ok | {"id": 7, "account_ids": ["4", 5, None]}, ok | {"id": 8, "account_ids": ["x", 5, None]}, ok | {"id": 9, "account_ids": 5},
            ok | {"id": 10, "account_ids": [1.5]}, ok | {"id": "abc"}, ok | {"id": 11, "initial_risk": "abc"}, ok | {"id": 12, "initial_risk": 99999999999999999999},
            ok | {"id": 13, "created_at": "nonsense"}, ok | {"id": 14, "account_ids": None, "created_at": "2024-06-03 10:00:00", "initial_risk": None},
            ok | {"id": 15, "account_ids": []}, ok | {"id": 16, "user_id": "7x", "account_ids": [99999999999]}]
    lines = [json.dumps(x) for x in sent] + ["[]", "null", "", "{", None]
    e = ledger.entries_from_json(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    users = spark.createDataFrame([(3, "x")], "id INT, username STRING")
    good = {r.id: r for r in ingest.ingest(e, users).collect()}
    assert set(good) == {1, 5, 7, 14, 15} and good[5].initial_risk == D("12.5000") and good[7].account_ids == [4, 5]
    bad = {(r.id, r.reasons) for r in ingest.rejects(e, users).collect()}
    assert bad == {(2, "bad_date"), (3, "bad_number"), (4, "out_of_range"), (6, "bad_user_id"), (None, "bad_json"), (8, "bad_accounts"), (9, "bad_accounts"),
                   (10, "bad_accounts"), (None, "bad_id"), (11, "bad_number"), (12, "out_of_range"), (13, "bad_created_at"), (16, "bad_user_id,bad_accounts")}
    assert ingest.rejects(e, users).filter("id is null").count() == 6


def test_written_ledger_prunes_months_through_filters(spark, tmp_dir):
    from pnlbook.operators import filters
    path = os.path.join(tmp_dir, "ledger")
    j = Journal(spark, SF_SMALL)
    ledger.write_ledger(j.trades, path)
    k = Journal(spark, SF_SMALL, ledger_path=path)
    for f in (lambda t: filters.by_month(t, "1998-06"), lambda t: filters.date_range(t, "1997-01-01", "1997-03-31"),
              lambda t: filters.trailing_days(t, "2001-08-01 12:00:00", 90), lambda t: filters.one_day(t, "1998-06-15")):
        df = f(k.trades)
        assert "PartitionFilters: [isnotnull(month" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == f(j.trades).count()


def test_default_accounts_active_account(spark):
    e = spark.createDataFrame([(1, 5, None), (2, 5, [7]), (3, 5, [])],
                              "id LONG, user_id INT, account_ids ARRAY<INT>")
    acc = spark.createDataFrame([(15, 5), (16, 5)], "id INT, user_id INT")
    got = sorted(tuple(r) for r in ingest.default_account_pairs(e, acc).select("id", "account_id").collect())
    assert got == [(1, 15), (1, 16), (2, 7)]
    got = sorted(tuple(r) for r in ingest.default_account_pairs(e, acc, 16)
                 .select("id", "account_id").collect())
    assert got == [(1, 16), (2, 7)]


def test_new_users_first_wins(spark):
    c = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("taken", 0)], "username STRING, seq LONG")
    ex = spark.createDataFrame([(1, "taken")], "id INT, username STRING")
    assert sorted(tuple(r) for r in ingest.new_users(c, ex).collect()) == [("a", 1), ("b", 2)]


def test_lookups_open_few_files(spark, tmp_dir):
    """A trade by id and a user's range: only the files whose bounds admit them are read."""
    path = os.path.join(tmp_dir, "ledger")
    trades = Journal(spark, SF_SMALL).trades
    ledger.write_ledger(trades, path)
    ledger.index_ledger(spark, path)
    want = trades.orderBy(F.desc("id")).first()
    one = ledger.find_trades(spark, path, want.user_id, want.id)
    every = len(ledger.read_ledger(spark, path).inputFiles())
    assert [r.id for r in one.collect()] == [want.id] and len(one.inputFiles()) < every / 4
    month = ledger.find_trades(spark, path, 7, None, "1998-06-01", "1998-06-30")
    assert len(month.inputFiles()) == 1
    assert month.count() == trades.filter("user_id = 7 and date between '1998-06-01' and '1998-06-30'").count()
    assert ledger.find_trades(spark, path, 999).count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id" in plan and "EqualTo(user_id" in plan


def test_an_empty_feed_runs(spark, tmp_dir):
    from pnlbook.streaming import feed
    seen = []
    feed.feed_in_slices(spark.createDataFrame([], "event_id LONG"), "event_id", 2, os.path.join(tmp_dir, "src"), seen.append)
    assert seen == [0, 1]
