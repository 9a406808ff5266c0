"""The query catalogue: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (through ``Journal``) in full; the
parameters are the fixed literals of the catalogue, the same as in the
SQL oracles (``pnlbook.plans.oracle``).
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pnlbook.functions import text
from pnlbook.operators import calendar_grid, changes, curve, filters, ordering, scoped, scores, stats, summaries
from pnlbook.operators import ingest as ing
from pnlbook.plans import batch, sql_api
from pnlbook.plans.context import Journal
from pnlbook.schemas import EVENTS, TOTAL
from pnlbook.session import scratch_dir
from pnlbook.sources import export, fixtures, ledger
from pnlbook.sources.tables import read_table
from pnlbook.streaming import feed, jobs, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def reg(fn):
        QUERIES[name] = fn
        return fn
    return reg


# ---- parameters of the catalogue (same literals as the SQL oracles) ---------
USER = 7
ACCOUNT = 22
RANGE_FROM, RANGE_TO = "1997-01-01", "1998-12-31"
API_FROM, API_TO = "1996-01-01", "2000-12-31"
MONTH = "1998-06"
DAY = "1998-06-15"
AS_OF = "2001-08-01 12:00:00"


def _j(spark, sf_dir) -> Journal:
    return Journal.of(spark, sf_dir)


@query("ingest_trades")
def q_ingest_trades(spark, sf_dir):
    return _j(spark, sf_dir).trades.select(
        "id", "user_id", "date", "type", "entry_price", "exit_price", "position_size", "pnl",
        "grade", "mental", "notes", "initial_risk")


@query("monthly_summary")
def q_monthly_summary(spark, sf_dir):
    return summaries.monthly_summary(_j(spark, sf_dir).trades)


@query("ingest_rejects")
def q_ingest_rejects(spark, sf_dir):
    j = _j(spark, sf_dir)
    return ing.rejects(j.raw_trades, j.users)


@query("orphan_trades")
def q_orphan_trades(spark, sf_dir):
    j = _j(spark, sf_dir)
    return ing.orphans(j.raw_trades, j.users).select("id", "user_id")


@query("pnl_only_entries")
def q_pnl_only_entries(spark, sf_dir):
    e = ing.pnl_only_entries(_j(spark, sf_dir).trade_changes)
    return e.select("seq", "type", "entry_price", "exit_price", "pnl")


@query("user_trades")
def q_user_trades(spark, sf_dir):
    t = filters.date_range(filters.by_user(_j(spark, sf_dir).trades, USER), RANGE_FROM, RANGE_TO)
    return ordering.with_position(t).select("position", "id", "date", "type", "pnl").orderBy("position")


@query("account_trades")
def q_account_trades(spark, sf_dir):
    t = filters.by_account(filters.by_user(_j(spark, sf_dir).trades, USER), ACCOUNT)
    return ordering.newest_first(t).select("id", "date", "pnl")


@query("month_trades")
def q_month_trades(spark, sf_dir):
    return filters.by_month(_j(spark, sf_dir).trades, MONTH).select("id", "user_id", "date", "pnl")


@query("trailing_trades")
def q_trailing_trades(spark, sf_dir):
    t = filters.trailing_days(_j(spark, sf_dir).trades, AS_OF, 30)
    return t.select("id", "user_id", "date", "pnl")


@query("day_trades")
def q_day_trades(spark, sf_dir):
    t = filters.one_day(_j(spark, sf_dir).trades, DAY)
    return t.select("id", "user_id", "type", text.currency(F.col("pnl")).alias("pnl_text"),
                    text.dash_if_empty(F.col("grade")).alias("grade"),
                    text.dash_if_empty(F.col("notes")).alias("notes"))


@query("daily_summary")
def q_daily_summary(spark, sf_dir):
    return summaries.daily_summary(_j(spark, sf_dir).trades)


@query("api_stats")
def q_api_stats(spark, sf_dir):
    j = _j(spark, sf_dir)
    return stats.api_stats(j.trades, j.users, API_FROM, API_TO)


@query("stat_card")
def q_stat_card(spark, sf_dir):
    j = _j(spark, sf_dir)
    return stats.stat_card(j.trades, j.users)


@query("account_stats")
def q_account_stats(spark, sf_dir):
    j = _j(spark, sf_dir)
    return stats.account_stats(j.trades, j.accounts, j.users)


@query("month_stats")
def q_month_stats(spark, sf_dir):
    return stats.month_stats(_j(spark, sf_dir).trades)


@query("best_day")
def q_best_day(spark, sf_dir):
    j = _j(spark, sf_dir)
    return stats.best_day(j.trades, j.users)


@query("side_split")
def q_side_split(spark, sf_dir):
    j = _j(spark, sf_dir)
    return stats.side_split(j.trades, j.users)


@query("account_counts")
def q_account_counts(spark, sf_dir):
    j = _j(spark, sf_dir)
    return stats.account_counts(j.accounts, j.users)


@query("equity_curve")
def q_equity_curve(spark, sf_dir):
    return curve.equity_curve(_j(spark, sf_dir).trades)


@query("equity_curve_90d")
def q_equity_curve_90d(spark, sf_dir):
    return curve.equity_curve_range(_j(spark, sf_dir).trades, AS_OF, 90)


@query("curve_end")
def q_curve_end(spark, sf_dir):
    return curve.curve_end(_j(spark, sf_dir).trades, AS_OF, 365)


def _months():
    first, _ = filters.month_bounds(MONTH)
    nxt = filters.month_bounds(f"{first.year + (first.month == 12)}-{first.month % 12 + 1:02d}")[0]
    return [MONTH, nxt.strftime("%Y-%m")]


@query("calendar_grid")
def q_calendar_grid(spark, sf_dir):
    j = _j(spark, sf_dir)
    return calendar_grid.calendar_grid(j.trades, j.users, _months())


@query("calendar_weeks")
def q_calendar_weeks(spark, sf_dir):
    j = _j(spark, sf_dir)
    return calendar_grid.calendar_weeks(calendar_grid.calendar_grid(j.trades, j.users, _months()))


@query("consistency")
def q_consistency(spark, sf_dir):
    j = _j(spark, sf_dir)
    return scores.consistency(j.trades, j.users, AS_OF, 365)


@query("edge_scores")
def q_edge_scores(spark, sf_dir):
    j = _j(spark, sf_dir)
    return scores.edge_scores(stats.stat_card(j.trades, j.users))


@query("card_labels")
def q_card_labels(spark, sf_dir):
    j = _j(spark, sf_dir)
    return scores.card_labels(stats.stat_card(j.trades, j.users))


# ---- the same figures by account ---------------------------------------------

def _by_account(spark, sf_dir, figure):
    j = _j(spark, sf_dir)
    return scoped.per_account(j.trades, j.accounts, figure)


@query("account_curve")
def q_account_curve(spark, sf_dir):
    return _by_account(spark, sf_dir, lambda t, u: curve.equity_curve(t))


@query("account_calendar")
def q_account_calendar(spark, sf_dir):
    return _by_account(spark, sf_dir, lambda t, u: calendar_grid.calendar_grid(t, u, _months()))


@query("account_consistency")
def q_account_consistency(spark, sf_dir):
    return _by_account(spark, sf_dir, lambda t, u: scores.consistency(t, u, AS_OF, 365))


@query("account_edge_scores")
def q_account_edge_scores(spark, sf_dir):
    return _by_account(spark, sf_dir, lambda t, u: scores.edge_scores(stats.stat_card(t, u)))


@query("account_labels")
def q_account_labels(spark, sf_dir):
    return _by_account(spark, sf_dir, lambda t, u: scores.card_labels(stats.stat_card(t, u)))


@query("month_steps")
def q_month_steps(spark, sf_dir):
    """H8: each month that a user traded in, with the months before and after."""
    t = _j(spark, sf_dir).trades.select("user_id", F.trunc("date", "month").alias("first")).distinct()
    return t.select("user_id", "first", text.month_step(F.col("first"), -1).alias("before"), text.month_step(F.col("first"), 1).alias("after"))


@query("trade_table")
def q_trade_table(spark, sf_dir):
    t = ordering.newest_first(ordering.with_position(_j(spark, sf_dir).trades))
    return t.select("user_id", "position", "id", "date", "type", text.currency(F.col("pnl")).alias("pnl_text"),
                    text.dash_if_empty(F.col("grade")).alias("grade"),
                    text.dash_if_empty(F.col("notes")).alias("notes"))


@query("account_list")
def q_account_list(spark, sf_dir):
    a = ordering.oldest_first(_j(spark, sf_dir).accounts)
    return (a.orderBy("user_id", "position")
            .select("user_id", "position", "id", "name", text.account_label(F.col("type"), F.col("size"))
                    .alias("label")))


@query("user_accounts")
def q_user_accounts(spark, sf_dir):
    """A2 for one user."""
    return ordering.oldest_first(_j(spark, sf_dir).accounts, USER).select("position", "id", "name", "created_at").orderBy("position")


@query("chart_order")
def q_chart_order(spark, sf_dir):
    """D3: every user's trades in the order of the chart."""
    return ordering.with_position(_j(spark, sf_dir).trades, newest=False).select("user_id", "position", "id", "date", "pnl")


def _indexed_ledger(spark, sf_dir):
    path = scratch_dir(spark, "ledger")
    ledger.write_ledger(_j(spark, sf_dir).trades, path)
    ledger.index_ledger(spark, path)
    return path


@query("trade_by_id")
def q_trade_by_id(spark, sf_dir):
    """C7 over the written, indexed ledger: the user's trade with the greatest id."""
    path = _indexed_ledger(spark, sf_dir)
    last = ledger.find_trades(spark, path, USER).agg(F.max("id")).first()[0]
    return ledger.find_trades(spark, path, USER, last).select("id", "user_id", "date", "type", "pnl")


@query("ledger_range")
def q_ledger_range(spark, sf_dir):
    """C1 and C2 over the written, indexed ledger."""
    return ledger.find_trades(spark, _indexed_ledger(spark, sf_dir), USER, None, RANGE_FROM, RANGE_TO).select("id", "date", "type", "pnl")


@query("change_outcomes")
def q_change_outcomes(spark, sf_dir):
    j = _j(spark, sf_dir)
    return changes.change_outcomes(j.trade_changes, j.users).select("seq", "op", "outcome")


@query("live_ledger")
def q_live_ledger(spark, sf_dir):
    j = _j(spark, sf_dir)
    return changes.live_ledger(j.trade_changes, j.users)


@query("account_changes")
def q_account_changes(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return changes.account_state(changes.account_changes_from_events(ev))


@query("account_outcomes")
def q_account_outcomes(spark, sf_dir):
    """What each account change did."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return changes.account_outcomes(changes.account_changes_from_events(ev)).select("seq", "op", "outcome")


@query("user_purge")
def q_user_purge(spark, sf_dir):
    j = _j(spark, sf_dir)
    purged = j.users.filter(F.col("id") % 5 == 0).select(F.col("id").alias("user_id"))
    return changes.purge_users(j.trades, purged).select("id", "user_id")


# ---- sources, sinks and the other ingest steps -------------------------------

@query("json_ingest")
def q_json_ingest(spark, sf_dir):
    """A3 + B10: the entries travel as JSON text and are parsed back."""
    j = _j(spark, sf_dir)
    t = ing.ingest(ledger.entries_from_json(fixtures.entries_json(j.raw_trades)), j.users)
    return t.select("id", "user_id", "date", "type", "entry_price", "exit_price", "position_size",
                    "pnl", "grade", "mental", "notes", "initial_risk")


@query("json_file_ingest")
def q_json_file_ingest(spark, sf_dir):
    """A3 from files: the entries written as JSON lines into the shared
    scratch folder, read back PERMISSIVE with an explicit schema, checked."""
    j = _j(spark, sf_dir)
    path = scratch_dir(spark, "entries-json")
    fixtures.entries_json(j.raw_trades).write.text(path)
    t = ing.ingest(ledger.read_entries(spark, path), j.users)
    return t.select("id", "user_id", "date", "type", "entry_price", "exit_price", "position_size",
                    "pnl", "grade", "mental", "notes", "initial_risk")


@query("json_rejects")
def q_json_rejects(spark, sf_dir):
    """Every refused JSON entry with its reasons, and the text
    of the lines that are not JSON."""
    j = _j(spark, sf_dir)
    return ing.rejects(ledger.entries_from_json(fixtures.entries_json(j.raw_trades)), j.users)


@query("ledger_append")
def q_ledger_append(spark, sf_dir):
    """A4 in two batches (the second sent twice), then A1."""
    j = _j(spark, sf_dir)
    path, bad = scratch_dir(spark, "ledger"), scratch_dir(spark, "ledger-rejects")
    odd = F.col("id") % 2 == 1
    for batch_id, part in ((0, ~odd), (1, odd), (1, odd)):
        batch.ingest_to_ledger(j.raw_trades.filter(part), j.users, path, bad, batch_id)
    t = ledger.read_ledger(spark, path)
    return t.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("trade_count"), F.sum("pnl").cast(TOTAL).alias("net_pnl"))


@query("ledger_roundtrip")
def q_ledger_roundtrip(spark, sf_dir):
    """A4 then A1: write the ledger by month into the shared scratch folder
    and read it back."""
    path = scratch_dir(spark, "ledger")
    ledger.write_ledger(_j(spark, sf_dir).trades, path)
    back = ledger.read_ledger(spark, path)
    return back.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("trade_count"))


@query("csv_lines")
def q_csv_lines(spark, sf_dir):
    return export.csv_lines(_j(spark, sf_dir).trades)


@query("csv_file")
def q_csv_file(spark, sf_dir):
    """A5: the export written as files and read back."""
    path = scratch_dir(spark, "csv")
    export.write_csv(_j(spark, sf_dir).trades, path)
    return (spark.read.options(header="true", quote='"', escape='"', emptyValue="").csv(path, schema="id STRING, date STRING, type STRING, "
            "entry_price STRING, exit_price STRING, position_size STRING, pnl STRING, notes STRING, created_at STRING")
            .select("id", "date", "type", "pnl", F.coalesce("notes", F.lit("")).alias("notes")))


def dirty_accounts(accounts: DataFrame) -> DataFrame:
    """Account edits with planted faults: padded names, blank names, type
    text in the wrong case or missing, sizes that are not numbers."""
    k = F.col("id")
    return accounts.select(
        "id", "user_id",
        F.when(k % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("name"), F.lit(" ")))
         .alias("name"),
        F.when(k % 4 == 1, F.upper(F.col("type"))).when(k % 4 == 2, F.lit(None).cast("string"))
         .otherwise(F.col("type")).alias("type"),
        F.when(k % 5 == 0, F.lit("abc")).otherwise(F.col("size").cast("string")).alias("size"))


@query("accounts_normalised")
def q_accounts_normalised(spark, sf_dir):
    n = ing.normalise_accounts(dirty_accounts(_j(spark, sf_dir).accounts))
    return n.filter("valid").select("id", "user_id", "name", "type", "size")


@query("default_accounts")
def q_default_accounts(spark, sf_dir):
    """Entries whose account list is missing (every 13th) get all of
    their user's accounts."""
    j = _j(spark, sf_dir)
    entries = j.trades.select(
        "id", "user_id",
        F.when(F.col("id") % 13 == 0, F.lit(None).cast("array<int>"))
         .otherwise(F.col("account_ids")).alias("account_ids"))
    return ing.default_account_pairs(entries, j.accounts).select("id", "account_id")


@query("new_users")
def q_new_users(spark, sf_dir):
    """Sign-ups named NATION_<custkey % 40>; names 0-24 are taken."""
    j = _j(spark, sf_dir)
    cand = read_table(spark, sf_dir, "customer", "c_custkey").select(
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string")).alias("username"),
        F.col("c_custkey").alias("seq"))
    return ing.new_users(cand, j.users).select("username", "seq")


# ---- streams ---------------------------------------------------------------------

STREAM_SLICES = 3


def _staged_stream(spark, sf_dir, name, start):
    """Write the events feed in seq slices; after each slice run the stream
    (availableNow) from the same checkpoint. Returns the scratch root."""
    root = scratch_dir(spark, name)
    src, ckpt = f"{root}/source", f"{root}/checkpoint"
    ev = read_table(spark, sf_dir, "events")

    def run(_i):
        q = start(src, root, ckpt)
        q.awaitTermination()

    feed.feed_in_slices(ev, "event_id", STREAM_SLICES, src, run)
    return root


@query("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    users = _j(spark, sf_dir).users
    root = _staged_stream(spark, sf_dir, "s1", lambda src, r, ck: jobs.run_ingest(
        spark, src, users, f"{r}/sink", f"{r}/rejects", ck))
    return spark.read.parquet(f"{root}/sink").select("seq", "type", "entry_price", "exit_price", "pnl")


@query("stream_daily_summary")
def q_stream_daily_summary(spark, sf_dir):
    users = _j(spark, sf_dir).users
    root = _staged_stream(spark, sf_dir, "s2", lambda src, r, ck: jobs.run_daily_summary(
        spark, src, users, f"{r}/state", f"{r}/sink", ck))
    return jobs.read_daily_summary(spark, f"{root}/sink")


@query("stream_ledger")
def q_stream_ledger(spark, sf_dir):
    users = _j(spark, sf_dir).users
    root = _staged_stream(spark, sf_dir, "s3", lambda src, r, ck: jobs.run_ledger(
        spark, src, users, f"{r}/ledger", ck))
    return jobs.read_ledger_state(spark, f"{root}/ledger")


# ---- the live dashboard --------------------------------------------------------

_LIVE: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _live_root(spark, sf_dir, purge: bool = False) -> str:
    """The live tables over the whole feed, built once a session: slices in an order
    that has nothing to do with seq, each run starting again from the checkpoint, the
    sums folded in between. With ``purge``, the first slice also purges every fifth
    user for good, so that most of their changes come after it."""
    built = _LIVE.setdefault(spark, {})
    if (sf_dir, purge) not in built:
        root = scratch_dir(spark, "live")
        src, users = f"{root}/source", _j(spark, sf_dir).users
        changes_ = fixtures.trade_changes(spark, sf_dir)
        turn = F.pmod(F.xxhash64("seq"), F.lit(STREAM_SLICES * 7))
        if purge:
            wiped = users.filter(F.col("id") % 5 == 0).select(F.lit(1 << 62).alias("seq"), F.lit("P").alias("op"), F.col("id").alias("user_id"))
            changes_ = changes_.unionByName(wiped, allowMissingColumns=True)
            turn = F.when(F.col("op") == "P", 0).otherwise(turn)
        schema = changes_.schema

        def run(i):
            live.run_live(spark.readStream.schema(schema).parquet(src), users, f"{root}/live", f"{root}/checkpoint").awaitTermination()
            if i == 1:
                live.fold_sums(spark, f"{root}/live")
                jobs.compact(spark, f"{root}/live")

        feed.feed_in_slices(changes_.withColumn("turn", turn), "turn", STREAM_SLICES, src, run)
        built[sf_dir, purge] = f"{root}/live"
    return built[sf_dir, purge]


@query("stream_outcomes")
def q_stream_outcomes(spark, sf_dir):
    """I4 on the stream."""
    return live.read_outcomes(spark, _live_root(spark, sf_dir))


@query("stream_stat_card")
def q_stream_stat_card(spark, sf_dir):
    """E4 live."""
    return live.read_stat_card(spark, _live_root(spark, sf_dir), _j(spark, sf_dir).users)


@query("stream_account_stats")
def q_stream_account_stats(spark, sf_dir):
    """E5 live."""
    j = _j(spark, sf_dir)
    return live.read_account_stats(spark, _live_root(spark, sf_dir), j.accounts, j.users)


@query("stream_month_stats")
def q_stream_month_stats(spark, sf_dir):
    """E6 live."""
    return live.read_month_stats(spark, _live_root(spark, sf_dir))


@query("stream_consistency")
def q_stream_consistency(spark, sf_dir):
    """E7, G1 and G2 live."""
    return live.read_consistency(spark, _live_root(spark, sf_dir), _j(spark, sf_dir).users)


@query("stream_curve")
def q_stream_curve(spark, sf_dir):
    """F1 live."""
    return live.read_curve(spark, _live_root(spark, sf_dir))


@query("stream_closed_days")
def q_stream_closed_days(spark, sf_dir):
    """Closed days with their corrections, and the days still open."""
    root = _live_root(spark, sf_dir)
    return (live.read_closed(spark, root).withColumn("closed", F.lit(True))
            .unionByName(live.read_open(spark, root).withColumn("closed", F.lit(False))))


@query("stream_user_purge")
def q_stream_user_purge(spark, sf_dir):
    """I6 on the stream: the live ledger and the live days without the purged users."""
    root = _live_root(spark, sf_dir, purge=True)
    rows = jobs.read_ledger_state(spark, root).select("user_id", "id", "date", "pnl")
    days = live.read_days(spark, root).where("account_id is null").select("user_id", "date", F.col("net_pnl").alias("day_pnl"))
    return rows.join(days, ["user_id", "date"], "full")


@query("stream_api_stats")
def q_stream_api_stats(spark, sf_dir):
    """E3 live, over a range of days."""
    return live.read_api_stats(spark, _live_root(spark, sf_dir), _j(spark, sf_dir).users, "2024-02-01", "2024-12-31")


def _account_stream(spark, sf_dir):
    def start(src, root, checkpoint):
        changes_ = changes.account_changes_from_events(spark.readStream.schema(EVENTS).parquet(src))
        return live.run_accounts(changes_, f"{root}/live", checkpoint)

    return f"{_staged_stream(spark, sf_dir, 's5', start)}/live"


@query("stream_accounts")
def q_stream_accounts(spark, sf_dir):
    """I5 on the stream: the accounts."""
    return live.read_accounts(spark, _account_stream(spark, sf_dir)).select("user_id", "id", "name", "type", "size")


@query("stream_account_outcomes")
def q_stream_account_outcomes(spark, sf_dir):
    """I5 on the stream: what each account change did."""
    return live.read_account_outcomes(spark, _account_stream(spark, sf_dir))


# ---- SQL ---------------------------------------------------------------------------

@query("sql_user_trades")
def q_sql_user_trades(spark, sf_dir):
    """C1-C3 as a table function of SQL."""
    sql_api.register(_j(spark, sf_dir))
    return spark.sql("SELECT id, date, type, pnl FROM user_trades(7, DATE'1997-01-01', DATE'1998-12-31', 22)")


@query("sql_views")
def q_sql_views(spark, sf_dir):
    """E1 and E2 as SQL views, joined by month."""
    sql_api.register(_j(spark, sf_dir))
    return spark.sql("""SELECT m.user_id, m.month, m.net_pnl, m.profit_factor, CAST(COUNT(*) AS BIGINT) AS days, CAST(MAX(d.daily_pnl) AS DECIMAL(28,4)) AS best_day
        FROM monthly_summary m JOIN daily_summary d ON d.user_id = m.user_id AND date_format(d.date, 'yyyy-MM') = m.month
        GROUP BY m.user_id, m.month, m.net_pnl, m.profit_factor""")
