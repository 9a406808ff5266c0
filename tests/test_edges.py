"""Hand-made edge rows (FIXTURES §6), expected values worked out by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pnlbook.functions import text
from pnlbook.operators import calendar_grid, filters, ingest, scores, stats
from pnlbook.schemas import RAW_TRADES
from pnlbook.sources import export

DAY = dt.date(2024, 6, 3)


def raw(spark, rows):
    """rows: (id, type, entry, exit, size) for user 1 on DAY."""
    full = [(i, 1, DAY, t, D(e) if e is not None else None, D(x) if x is not None else None,
             D(s) if s is not None else None, "A", "calm", None, None, [1], None)
            for i, t, e, x, s in rows]
    return spark.createDataFrame(full, RAW_TRADES)


def users(spark, ids=(1, 2)):
    return spark.createDataFrame([(i, f"u{i}") for i in ids], "id INT, username STRING")


def trades(spark, rows, user=1):
    """rows: (date, pnl) or (date, pnl, type)."""
    data = [(k, user, d, (r[2] if len(r) > 2 else "LONG"), D(str(r[1])), [1])
            for k, r in enumerate(rows)
            for d in [r[0]]]
    return spark.createDataFrame(
        data, "id LONG, user_id INT, date DATE, type STRING, pnl DECIMAL(18,4), account_ids ARRAY<INT>")


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_pnl_sign_size_default_and_half_cent(spark):
    df = ingest.ingest(raw(spark, [
        (1, "LONG", "100", "105", "2"), (2, "SHORT", "100", "105", "2"),
        (3, "LONG", "100", "105", None), (4, "LONG", "100", "105", "0"),
        (5, "LONG", "100", "100.0050", "1"), (6, "SHORT", "100", "100.0050", "1"),
        (7, "LONG", "100", "100", "1")]), users(spark))
    r = by_id(df)
    assert r[1].pnl == D("10.0000") and r[2].pnl == D("-10.0000")
    assert r[3].pnl == D("5.0000") and r[3].position_size == D("1.0000")
    assert r[4].pnl == D("5.0000") and r[4].position_size == D("1.0000")
    assert r[5].pnl == D("0.0100") and r[6].pnl == D("-0.0100")
    assert r[7].pnl == D("0.0000")


def test_rejects_and_reasons(spark):
    rows = raw(spark, [(1, "FLAT", "100", "101", "1"), (2, "LONG", None, "101", "1"),
                       (3, None, "100", "101", "1"), (5, "", "100", "101", "1")])
    rows = rows.unionByName(raw(spark, [(4, "LONG", "100", "101", "1")])
                            .withColumn("user_id", F.lit(99)))
    r = by_id(ingest.rejects(rows, users(spark)))
    assert r[1].reasons == "bad_type"
    assert r[2].reasons == "missing_entry_price"
    assert r[3].reasons == "missing_type" and r[5].reasons == "missing_type"
    assert r[4].reasons == "unknown_user"


def test_overflow_is_rejected(spark):
    df = raw(spark, [(1, "LONG", "1", "99999999999999", "99999999999999")])
    assert by_id(ingest.rejects(df, users(spark)))[1].reasons == "out_of_range"


def test_flat_trade_counts_in_total_only(spark):
    t = trades(spark, [(DAY, "0"), (DAY, "5")])
    c = by_id(stats.stat_card(t, users(spark)), "user_id")[1]
    assert (c.total, c.wins, c.losses) == (2, 1, 0)


def test_user_without_trades(spark):
    t = trades(spark, [(DAY, "5")])
    api = by_id(stats.api_stats(t, users(spark)), "user_id")[2]
    assert (api.total, api.win_rate, api.net_pnl, api.profit_factor) == (0, D("0.0"), D("0.0000"), None)
    card = by_id(stats.stat_card(t, users(spark)), "user_id")[2]
    assert card.profit_factor == D("0.00") and not card.pf_unbounded and card.avg_rr is None


def test_wins_only(spark):
    t = trades(spark, [(DAY, "10"), (DAY, "20")])
    api = by_id(stats.api_stats(t, users(spark)), "user_id")[1]
    assert api.profit_factor is None
    card = stats.stat_card(t, users(spark))
    c = by_id(card, "user_id")[1]
    assert c.pf_unbounded and c.profit_factor is None
    e = by_id(scores.edge_scores(card), "user_id")[1]
    assert e.pf_score == D("100.0000")
    lab = by_id(scores.card_labels(card), "user_id")[1]
    assert lab.pf_text == "∞" and lab.pf_class == "green"


def test_losses_only(spark):
    t = trades(spark, [(DAY, "-10")])
    c = by_id(stats.stat_card(t, users(spark)), "user_id")[1]
    assert c.profit_factor == D("0.00") and c.avg_rr is None
    k = by_id(scores.consistency(t, users(spark)), "user_id")[1]
    assert k.consistency_pct is None and k.band == "none"


def test_win_rate_tie_rounds_half_up(spark):
    rows = [(DAY, "1")] * 23 + [(DAY, "-1")] * 57
    c = by_id(stats.stat_card(trades(spark, rows), users(spark)), "user_id")[1]
    assert c.win_rate == D("28.8")


def test_reward_to_risk_from_rounded_averages(spark):
    # avg win 10/3 = 3.33, avg loss 3 -> 3.33 / 3 = 1.11
    rows = [(DAY, "3.33"), (DAY, "3.33"), (DAY, "3.34"), (DAY, "-3")]
    c = by_id(stats.stat_card(trades(spark, rows), users(spark)), "user_id")[1]
    assert (c.avg_win, c.avg_loss, c.avg_rr) == (D("3.33"), D("3.00"), D("1.11"))


def test_consistency_bands(spark):
    t = trades(spark, [(DAY, "60"), (DAY + dt.timedelta(days=1), "40")])
    k = by_id(scores.consistency(t, users(spark)), "user_id")[1]
    assert k.consistency_pct == D("60.0") and k.band == "poor"
    t = trades(spark, [(DAY, "60"), (DAY + dt.timedelta(days=1), "-60")])
    k = by_id(scores.consistency(t, users(spark)), "user_id")[1]
    assert k.consistency_pct is None and k.band == "none"
    t = trades(spark, [(DAY + dt.timedelta(days=i), "10") for i in range(4)])
    assert by_id(scores.consistency(t, users(spark)), "user_id")[1].band == "good"


def test_calendar_zero_day(spark):
    t = trades(spark, [(DAY, "5"), (DAY, "-5")])
    g = calendar_grid.calendar_grid(t, users(spark, [1]), ["2024-06"])
    cell = [r for r in g.collect() if r.date == DAY][0]
    assert (cell.trade_count, cell.pnl, cell.day_class, cell.pnl_sign, cell.count_text) == \
        (2, D("0.0000"), "loss", "pos", "2 trades")


@pytest.mark.parametrize("month,weeks,lead,trail", [("2024-08", 5, 4, 0), ("2024-06", 6, 6, 6)])
def test_calendar_shape(spark, month, weeks, lead, trail):
    t = trades(spark, [(DAY, "5")])
    g = calendar_grid.calendar_grid(t, users(spark, [1]), [month]).orderBy("week_index", "dow").collect()
    assert len(g) == 7 * weeks
    dates = [r.date for r in g]
    assert dates[:lead] == [None] * lead and dates[lead] is not None
    assert sum(d is None for d in dates) == lead + trail
    assert g[0].month_label == {"2024-08": "August 2024", "2024-06": "June 2024"}[month]
    w = calendar_grid.calendar_weeks(calendar_grid.calendar_grid(t, users(spark, [1]), [month]))
    assert w.count() == weeks


def test_trailing_range_depends_on_time_of_day():
    assert filters.trailing_cutoff("2024-06-10 12:00:00", 7) == dt.date(2024, 6, 4)
    assert filters.trailing_cutoff("2024-06-10 00:00:00", 7) == dt.date(2024, 6, 3)


def test_trailing_range_rows(spark):
    t = trades(spark, [(dt.date(2024, 6, 3), "1"), (dt.date(2024, 6, 4), "2"), (dt.date(2024, 6, 20), "3")])
    kept = sorted(r.date for r in filters.trailing_days(t, "2024-06-10 12:00:00", 7).collect())
    assert kept == [dt.date(2024, 6, 4), dt.date(2024, 6, 20)]


def test_currency_and_number_text(spark):
    df = spark.createDataFrame([(D("1234.5"),), (D("-45"),), (D("0"),), (D("1000000"),)],
                               "x DECIMAL(18,4)")
    got = [r[0] for r in df.select(text.currency(F.col("x"))).collect()]
    assert got == ["+$1,234.50", "-$45.00", "+$0.00", "+$1,000,000.00"]
    n = spark.createDataFrame([(D("1.50"),), (D("2.00"),), (D("0.00"),), (D("10.05"),)], "x DECIMAL(18,2)")
    assert [r[0] for r in n.select(text.number_text(F.col("x"))).collect()] == ["1.5", "2", "0", "10.05"]


def test_small_texts(spark):
    df = spark.createDataFrame([(1, "prop", D("50000")), (2, "live", D("1234.5"))],
                               "n LONG, kind STRING, size DECIMAL(18,4)")
    r = df.select(text.trade_count_text(F.col("n")).alias("c"),
                  text.account_label(F.col("kind"), F.col("size")).alias("l"),
                  text.dash_if_empty(F.lit("")).alias("d"),
                  text.month_step(F.lit(dt.date(2024, 12, 15)), 1).alias("m")).collect()
    assert [x.c for x in r] == ["1 trade", "2 trades"]
    assert [x.l for x in r] == ["🏆 Prop Firm · $50,000", "💼 Live · $1,234.5"]
    assert r[0].d == "—" and r[0].m == dt.date(2025, 1, 1)


def test_csv_field_reads_back(spark, tmp_dir):
    note = 'a "b", c\nnext line  '
    t = spark.createDataFrame(
        [(1, DAY, "LONG", D("100"), D("101"), D("1"), D("1"), note, dt.datetime(2024, 6, 3, 9, 30))],
        "id LONG, date DATE, type STRING, entry_price DECIMAL(18,4), exit_price DECIMAL(18,4), "
        "position_size DECIMAL(18,4), pnl DECIMAL(18,4), notes STRING, created_at TIMESTAMP_NTZ")
    line = export.csv_lines(t).first().line
    assert line.startswith('"1","2024-06-03","LONG","100.0000"') and '"a ""b"", c\nnext line  "' in line
    export.write_csv(t, tmp_dir + "/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(tmp_dir + "/csv")
    assert back.first().notes == note


def test_repeated_account_id_counts_once(spark):
    t = spark.createDataFrame([(1, 1, DAY, "LONG", D("5"), [3, 3]), (2, 1, DAY, "LONG", D("-1"), [3])],
                              "id LONG, user_id INT, date DATE, type STRING, pnl DECIMAL(18,4), account_ids ARRAY<INT>")
    acc = spark.createDataFrame([(3, 1, "a", "live", D("0"))], "id INT, user_id INT, name STRING, type STRING, size DECIMAL(18,4)")
    r = {x.account_id: x for x in stats.account_stats(t, acc, users(spark, [1])).collect()}
    assert (r[3].total, r[3].net_pnl) == (2, D("4.0000"))
    pairs = ingest.default_account_pairs(t.select("id", "user_id", "account_ids"), acc).collect()
    assert sorted((p.id, p.account_id) for p in pairs) == [(1, 3), (2, 3)]


def test_extreme_but_legal_amounts_do_not_fail(spark):
    """A tiny net, a factor without bound and sums past one amount's range."""
    from pnlbook.operators import curve, scores, stats
    big = D("99999999999999.0000")
    rows = [(1, "2024-01-01", D("1000.0000")), (1, "2024-01-02", D("-999.9900")),
            (2, "2024-01-01", D("30000.0000")), (2, "2024-01-02", D("-0.0100")), *[(3, "2024-01-0%d" % k, big) for k in (1, 1, 2, 3)]]
    t = spark.createDataFrame([(u, dt.date.fromisoformat(d), "LONG", p) for u, d, p in rows], "user_id INT, date DATE, type STRING, pnl DECIMAL(18,4)")
    users = spark.createDataFrame([(k,) for k in (1, 2, 3)], "id INT")
    c = {r.user_id: r for r in scores.consistency(t, users).collect()}
    assert c[1].consistency_pct == D("10000000.0") and c[1].band == "poor"
    e = {r.user_id: r for r in scores.edge_scores(stats.stat_card(t, users)).collect()}
    assert e[2].pf_score == D("100.0000") and e[2].rr_score == D("100.0000")
    assert max(r.cum_pnl for r in curve.equity_curve(t).collect()) == 4 * big
