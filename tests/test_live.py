"""The live dashboard after any batches, in any order, equals the batch figures."""

import datetime as dt
import os
import random
from decimal import Decimal

from pyspark.sql import functions as F

from pnlbook.operators import curve, scores, stats, summaries
from pnlbook.streaming import jobs, live

SCHEMA = "seq LONG, ts TIMESTAMP_NTZ, op STRING, user_id INT, id LONG, date DATE, type STRING, pnl_input DECIMAL(18,4), account_ids ARRAY<INT>"
T0 = dt.datetime(2024, 1, 1)


def change(seq, op, user, key=None, day=0, pnl=0.0, accounts=(), side="LONG"):
    t = T0 + dt.timedelta(days=day)
    return (seq, t, op, user, key, t.date(), side, None if pnl is None else Decimal(f"{pnl:.4f}"), list(accounts))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def plain_live(rows):
    """Row-by-row replay in the order of seq: live trades, and what each change did."""
    here, outcomes = {}, {}
    for r in sorted(rows):
        seq, _, op, user, key, day, side, pnl, accounts = r
        if op == "P":
            here = {k: v for k, v in here.items() if k[0] != user}
            continue
        at, bad = (user, key), op != "D" and pnl is None
        there = at in here
        outcomes[seq] = ("rejected" if bad else "duplicate" if op == "I" and there else "created" if op == "I" else
                         "not_found" if not there else "updated" if op == "U" else "deleted")
        if outcomes[seq] in ("created", "updated"):
            here[at] = (user, key, day, side, pnl, accounts)
        elif outcomes[seq] == "deleted":
            del here[at]
    return list(here.values()), outcomes


def check_all(spark, root, rows, users):
    trades, outcomes = plain_live(rows)
    want = spark.createDataFrame(trades, "user_id INT, id LONG, date DATE, type STRING, pnl DECIMAL(18,4), account_ids ARRAY<INT>")
    assert {r.seq: r.outcome for r in live.read_outcomes(spark, root).collect()} == outcomes
    assert rows_of(live.read_stat_card(spark, root, users)) == rows_of(stats.stat_card(want, users))
    accounts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id INT, user_id INT")
    assert rows_of(live.read_account_stats(spark, root, accounts, users)) == rows_of(stats.account_stats(want, accounts, users))
    assert rows_of(live.read_month_stats(spark, root)) == rows_of(stats.month_stats(want))
    assert rows_of(live.read_consistency(spark, root, users)) == rows_of(scores.consistency(want, users))
    assert rows_of(live.read_curve(spark, root)) == rows_of(curve.equity_curve(want))
    days = live.read_closed(spark, root).unionByName(live.read_open(spark, root)).select("user_id", "date", F.col("total").alias("trade_count"), F.col("net_pnl").alias("daily_pnl"))
    assert rows_of(days) == rows_of(summaries.daily_summary(want).select(days.columns))
    assert rows_of(jobs.read_ledger_state(spark, root).select("user_id", "id", "pnl")) == rows_of(want.select("user_id", "id", "pnl"))


def test_any_batches_in_any_order(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(live, "TOPS", 2)
    rng = random.Random(5)
    users = spark.createDataFrame([(1,), (2,), (3,)], "id INT")
    rows = []
    for seq in range(400):
        op = rng.choice("IIIUUDD")
        rows.append(change(seq, op, rng.choice([1, 1, 2, 2]), rng.randrange(40), rng.randrange(100), None if rng.random() < 0.05 else rng.randint(-50, 50),
                           rng.sample([1, 2, 3, 9], rng.randrange(3)), rng.choice(["LONG", "SHORT"])))
    rows.append(change(250, "P", 2)[:4] + (None,) * 5)
    rows = [r for r in rows if r[0] != 250 or r[2] == "P"]
    rng.shuffle(rows)
    rows = [r for r in rows if r[2] != "P"][:150] + [r for r in rows if r[2] == "P"] + [r for r in rows if r[2] != "P"][150:]   # the purge comes amid the others
    root = os.path.join(tmp_dir, "live")
    cuts = [0, 120, 180, 181, 300, len(rows)]
    for b in range(5):
        live.write_batch(frame(spark, rows[cuts[b]:cuts[b + 1]]), b, users, root, buckets=4)
        if b == 1:
            jobs.compact(spark, root)
            assert live.fold_sums(spark, root) == 1
            live.write_batch(frame(spark, rows[cuts[1]:cuts[2]]), 1, users, root, buckets=4)      # run again after the fold
    check_all(spark, root, rows, users)


def test_crash_compact_retry(spark, tmp_dir):
    """A batch is in the log, the job dies before its difference, the log is compacted, the batch comes again."""
    root = os.path.join(tmp_dir, "live")
    users = spark.createDataFrame([(1,), (2,), (3,)], "id INT")
    first = [change(k, "I", 1, k, k, 10) for k in range(6)]
    second = [change(10, "D", 1, 0), change(11, "U", 1, 1, 1, -5), change(12, "I", 2, 7, 3, 4)]
    live.write_batch(frame(spark, first), 0, users, root)
    jobs.append_changes(frame(spark, second), users, root, 1)
    assert jobs.compact(spark, root) == 1
    live.write_batch(frame(spark, second), 1, users, root)
    check_all(spark, root, first + second, users)
    before, after = jobs.states(spark, root, 1)
    assert (before.count(), after.count()) == (2, 2)                # the state the batch began with is still there


def test_best_day_deleted_and_refilled(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(live, "TOPS", 2)
    root = os.path.join(tmp_dir, "live")
    users = spark.createDataFrame([(1,)], "id INT")
    best = lambda: float(live.read_consistency(spark, root, users).first().best_day)
    rows = [change(k, "I", 1, k, k, 10 * k) for k in range(1, 7)]
    live.write_batch(frame(spark, rows), 0, users, root)
    assert best() == 60
    live.write_batch(frame(spark, [change(10, "D", 1, 6), change(11, "D", 1, 5)]), 1, users, root)        # both kept days go: refill
    assert best() == 40
    live.write_batch(frame(spark, [change(12, "U", 1, 4, 4, 1), change(13, "U", 1, 1, 1, 35)]), 2, users, root)
    assert best() == 35
    live.write_batch(frame(spark, [change(20 + k, "D", 1, k) for k in range(1, 5)]), 3, users, root)
    assert best() == 0 and live.read_best_day(spark, root).count() == 0


def test_late_day_rewrites_one_month_and_later_offsets(spark, tmp_dir):
    root = os.path.join(tmp_dir, "live")
    rows = [change(k, "I", u, k, 5 * k, 1) for k in range(73) for u in (1, 2)]          # a year of every fifth day
    rows = [(2 * k + i, *r[1:]) for i in (0, 1) for k, r in enumerate(rows[i::2])]
    live.write_batch(frame(spark, rows), 0, None, root)
    late = change(1000, "I", 1, 500, 66, 7)                                              # one day in March
    live.write_batch(frame(spark, [late]), 1, None, root)
    wrote = lambda table: spark.read.parquet(f"{root}/{table}/batch_id=1")
    march = sum((T0 + dt.timedelta(days=5 * k)).month == 3 for k in range(73))
    assert wrote("curve_days").count() == march + 1                                      # of 147 days of two users
    assert wrote("curve_months").count() == 10 and wrote("curve_months").select("user_id").distinct().count() == 1
    end = live.read_curve(spark, root).where("user_id = 1").orderBy(F.desc("date")).first()
    assert float(end.cum_pnl) == 80
    assert rows_of(live.read_curve(spark, root)) == rows_of(curve.equity_curve(jobs.read_ledger_state(spark, root)))


def test_closed_days_are_final_once_and_corrected(spark, tmp_dir):
    root = os.path.join(tmp_dir, "live")
    batches = [[change(1, "I", 1, 1, 0, 5), change(2, "I", 1, 2, 3, 6)], [change(3, "I", 1, 3, 20, 1)],
               [change(4, "I", 1, 4, 0, 2), change(5, "D", 1, 2, 21)], [change(6, "I", 1, 5, 40, 9)]]
    for b, rows in enumerate(batches):
        live.write_batch(frame(spark, rows), b, None, root, delay_days=7)
    closed = spark.read.parquet(f"{root}/closed")
    assert closed.count() == closed.select("user_id", "date").distinct().count() == 3    # days 0 and 3 by the second batch, day 20 by the last
    late = {(r.batch_id, r.date.day): (r.total, float(r.net_pnl)) for r in spark.read.parquet(f"{root}/corrections").collect()}
    assert late == {(2, 1): (1, 2.0), (2, 4): (-1, -6.0)}
    assert sorted((r.date.day, r.date.month, float(r.net_pnl)) for r in live.read_closed(spark, root).collect()) == [(1, 1, 7.0), (21, 1, 1.0)]
    assert [r.date for r in live.read_open(spark, root).collect()] == [dt.date(2024, 2, 10)]


def test_purge_before_and_after_its_changes(spark, tmp_dir):
    root = os.path.join(tmp_dir, "live")
    purge = (50, None, "P", 1, None, None, None, None, None)
    batches = [[change(1, "I", 1, 1, 0, 5), change(2, "I", 2, 1, 0, 6)], [purge], [change(3, "I", 1, 2, 1, 7), change(40, "U", 1, 1, 0, 8)],
               [change(60, "I", 1, 1, 2, 9), change(61, "U", 1, 2, 1, 3)]]
    for b, rows in enumerate(batches):
        live.write_batch(frame(spark, rows), b, None, root)
        if b == 2:
            jobs.compact(spark, root)
    assert sorted((r.user_id, r.id, float(r.pnl)) for r in jobs.read_ledger_state(spark, root).collect()) == [(1, 1, 9.0), (2, 1, 6.0)]
    assert sorted((r.user_id, float(r.net_pnl)) for r in live.read_days(spark, root).where("account_id is null").collect()) == [(1, 9.0), (2, 6.0)]
    users = spark.createDataFrame([(1,), (2,), (3,)], "id INT")
    check_all(spark, root, [r for b in batches for r in b], users)


def test_few_users_are_pushed_down(spark, tmp_dir):
    root = os.path.join(tmp_dir, "live")
    live.write_batch(frame(spark, [change(k, "I", k % 50, k, k, 1) for k in range(200)]), 0, None, root)
    some = spark.createDataFrame([(3,), (4,)], "user_id INT")
    plan = jobs.for_users(live.read_sums(spark, root, "days"), some)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(user_id, [3,4])]" in plan


def test_both_states_come_from_one_pass(spark, tmp_dir):
    """Not a plan for each state, and no column that no sum needs."""
    root = os.path.join(tmp_dir, "live")
    users = spark.createDataFrame([(1,), (2,)], "id INT")
    live.write_batch(frame(spark, [change(k, "I", 1 + k % 2, k, k, 10, (1,)) for k in range(6)]), 0, users, root)
    jobs.append_changes(frame(spark, [change(10, "D", 1, 0), change(11, "U", 2, 1, 1, -5, (1, 2)), change(12, "I", 2, 7, 3, 4)]), users, root, 1)
    deltas = live.day_deltas(jobs.state_changes(spark, root, 1, live.DAY_COLUMNS))
    plan = deltas._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 3 and "mental" not in plan.split("ReadSchema", 1)[1]
    days = {(r.user_id, r.account_id, r.date.day): (r.total, float(r.net_pnl)) for r in deltas.collect()}
    assert days == {(1, None, 1): (-1, -10.0), (1, 1, 1): (-1, -10.0), (2, None, 2): (0, -15.0), (2, 1, 2): (0, -15.0), (2, 2, 2): (1, -5.0),
                    (2, None, 4): (1, 4.0)}
