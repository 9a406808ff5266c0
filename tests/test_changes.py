"""The change-log fold against a plain row-by-row replay."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from pnlbook.operators import changes
from pnlbook.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


SCHEMA = ("seq LONG, ts TIMESTAMP_NTZ, op STRING, user_id INT, id LONG, date DATE, type STRING, pnl_input DECIMAL(18,4)")


def feed(seed, n=300, bad=False):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        u, k = rnd.randrange(3), rnd.randrange(5)
        op = rnd.choice("IIUUD")
        side = rnd.choice(["LONG", "SHORT"] + (["FLAT"] if bad else []))
        rows.append((seq * 3 + rnd.randrange(3), T0 + dt.timedelta(minutes=seq), op, u, u * 10 + k,
                     dt.date(2024, 1, 1 + seq % 28), side, D(rnd.randrange(-500, 500)) / 100))
    return rows


def replay(rows):
    live, out = {}, {}
    for seq, ts, op, u, i, d, side, p in sorted(rows):
        key = (u, i)
        valid = side in ("LONG", "SHORT")
        if op != "D" and not valid:
            out[seq] = "rejected"
        elif op == "I":
            out[seq] = "duplicate" if key in live else "created"
            if key not in live:
                live[key] = dict(date=d, type=side, pnl=p, born=seq, seq=seq, created_at=ts)
        elif op == "U":
            out[seq] = "updated" if key in live else "not_found"
            if key in live:
                live[key].update(date=d, type=side, pnl=p, seq=seq)
        else:
            out[seq] = "deleted" if key in live else "not_found"
            live.pop(key, None)
    return out, live


def as_rows(df):
    return {(r.user_id, r.id): dict(date=r.date, type=r.type, pnl=r.pnl, born=r.born, seq=r.seq,
                                    created_at=r.created_at) for r in df.collect()}


@pytest.mark.parametrize("seed,span", [(1, 1 << 20), (2, 7), (3, 2), (4, 50)])
def test_fold_equals_replay(spark, seed, span):
    rows = feed(seed, bad=seed % 2 == 0)
    df = spark.createDataFrame(rows, SCHEMA)
    want_out, want_live = replay(rows)
    got_out = {r.seq: r.outcome for r in changes.change_outcomes(df, chunk_span=span).collect()}
    assert got_out == want_out
    got_live = as_rows(changes.live_ledger(df))
    want = {k: {**v, "pnl": D(v["pnl"]).quantize(D("0.0001"))} for k, v in want_live.items()}
    assert got_live == want


@pytest.mark.parametrize("seed,cuts", [(5, 3), (6, 6)])
def test_log_in_any_order_equals_one_fold(spark, tmp_dir, seed, cuts):
    """Batches that arrive out of seq order, an empty one, a rerun, compaction in between."""
    rows = feed(seed, n=240, bad=True)
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    points = sorted(rnd.sample(range(1, len(rows)), cuts - 1))
    pieces = [[], *(rows[a:b] for a, b in zip([0] + points, points + [len(rows)], strict=True))]
    for n, piece in enumerate(pieces):
        batch = spark.createDataFrame(piece, SCHEMA)
        jobs.append_changes(batch, None, tmp_dir, n, buckets=4)
        if n == 2:
            jobs.append_changes(batch, None, tmp_dir, n, buckets=4)        # the same batch again
            assert jobs.compact(spark, tmp_dir) == 2
    assert as_rows(jobs.read_ledger_state(spark, tmp_dir)) == as_rows(changes.live_ledger(spark.createDataFrame(rows, SCHEMA)))


def test_crash_between_snapshot_and_pointer_keeps_the_old_state(spark, tmp_dir, monkeypatch):
    rows = feed(9, n=120)
    jobs.append_changes(spark.createDataFrame(rows[:60], SCHEMA), None, tmp_dir, 0)
    jobs.compact(spark, tmp_dir)
    jobs.append_changes(spark.createDataFrame(rows[60:], SCHEMA), None, tmp_dir, 1)
    want = as_rows(changes.live_ledger(spark.createDataFrame(rows, SCHEMA)))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.compact(spark, tmp_dir)
    assert as_rows(jobs.read_ledger_state(spark, tmp_dir)) == want
    assert jobs.compact(spark, tmp_dir) == 1 and as_rows(jobs.read_ledger_state(spark, tmp_dir)) == want


def test_full_changes_and_refusals(spark):
    """Whole trades, PnL-only entries, unknown users and bad fields in one feed."""
    day = dt.date(2024, 3, 1)
    cols = SCHEMA + ", entry_price DECIMAL(18,4), exit_price DECIMAL(18,4), position_size DECIMAL(18,4), grade STRING, account_ids ARRAY<INT>"
    rows = [(1, T0, "I", 1, 1, day, "LONG", None, D(10), D(12), D(3), "A", [4]), (2, T0, "U", 1, 1, day, "SHORT", None, D(10), D(12), D(0), "", None),
            (3, T0, "I", 1, 2, day, "LONG", D(5), None, None, None, None, None), (4, T0, "I", 9, 3, day, "LONG", D(5), None, None, None, None, None),
            (5, T0, "U", 1, 2, day, "LONG", None, None, None, None, None, None), (6, T0, "I", 1, 4, day, "LONG", D(5), None, None, None, "AAAA", None)]
    df = spark.createDataFrame(rows, cols)
    users = spark.createDataFrame([(1,), (1,)], "id INT")
    out = {r.seq: r.outcome for r in changes.change_outcomes(df, users).collect()}
    assert out == {1: "created", 2: "updated", 3: "created", 4: "rejected", 5: "rejected", 6: "rejected"}
    live = {r.id: r for r in changes.live_ledger(df, users).collect()}
    assert set(live) == {1, 2} and live[1].pnl == D(-2) and live[1].grade is None and live[1].account_ids == [] and live[1].position_size == 1
    assert live[2].pnl == D(5) and live[2].exit_price == D(105)


def test_account_fold_rejects_nameless(spark):
    rows = [(1, T0, "I", 1, 3, "  main ", "prop", "100"), (2, T0, "U", 1, 3, "   ", "live", "5"),
            (3, T0, "U", 1, 3, "main2", "weird", "x"), (4, T0, "I", 1, 4, None, "live", "1"),
            (5, T0, "D", 1, 5, None, None, None)]
    df = spark.createDataFrame(rows, "seq LONG, ts TIMESTAMP_NTZ, op STRING, user_id LONG, id LONG, "
                                     "name STRING, type STRING, size STRING")
    got = [tuple(r) for r in changes.account_state(df).collect()]
    assert got == [(1, 3, "main2", "live", D("0.0000"))]


def test_purge_removes_trades_of_user(spark):
    t = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id LONG, user_id INT")
    p = spark.createDataFrame([(1,)], "user_id INT")
    assert sorted(r.id for r in changes.purge_users(t, p).collect()) == [2]


def test_hot_key_fold_equals_replay(spark):
    """One key holds most of the feed; tiny chunks split it across many
    window partitions and the result still equals the replay."""
    rnd = random.Random(11)
    rows = []
    for seq in range(400):
        hot = rnd.random() < 0.7
        u, k = (1, 11) if hot else (rnd.randrange(3), rnd.randrange(3) * 10)
        rows.append((seq, T0 + dt.timedelta(minutes=seq), rnd.choice("IUUD"), u, k,
                     dt.date(2024, 2, 1 + seq % 28), rnd.choice(["LONG", "SHORT"]),
                     D(rnd.randrange(-900, 900)) / 100))
    df = spark.createDataFrame(rows, SCHEMA)
    want_out, want_live = replay(rows)
    for span in (3, 16):
        got = {r.seq: r.outcome for r in changes.change_outcomes(df, chunk_span=span).collect()}
        assert got == want_out
        live = as_rows(changes.live_ledger(df))
        assert live == {k: {**v, "pnl": D(v["pnl"]).quantize(D("0.0001"))} for k, v in want_live.items()}
