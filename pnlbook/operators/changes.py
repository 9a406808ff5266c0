"""The write API as a change log.

A feed of changes (seq, op in I/U/D, key, payload) is folded into the live
ledger. ``seq`` is arrival order. Per key a change sees the key as *live*
when the last insert before it is later than the last delete before it:

    I on a dead key -> created      I on a live key -> duplicate (no change)
    U on a live key -> updated      U on a dead key -> not_found
    D on a live key -> deleted      D on a dead key -> not_found

"Last I / last D before this row" is a running max per key. A plain window
per key would put a hot key (say a third of the feed) into one task, so the
scan is done in two levels: per (key, seq chunk) summaries are combined by
a window over chunks (one row per chunk), and each row only scans inside
its own chunk. No window partition is larger than one chunk of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pnlbook.functions.money import dec
from pnlbook.operators.ingest import (PNL_ONLY_ENTRY_PRICE, check_entries, normalise_accounts, number_in,
                                      with_defaults)
from pnlbook.plans.joins import bounded_broadcast
from pnlbook.schemas import MONEY, TRADE_CHANGES

KEY = ["user_id", "id"]
# Width of a seq chunk of the two-level scan; bounds a window partition.
CHUNK_SPAN = 1 << 20

OUTCOMES = ("created", "duplicate", "updated", "deleted", "not_found", "rejected")


def _prior_max(df: DataFrame, key: list[str], chunk_span: int) -> DataFrame:
    """Add prior_i / prior_d: greatest seq of an accepted I / a D of the
    same key strictly before each row (``_ok`` marks accepted rows)."""
    is_i = F.when((F.col("op") == "I") & F.col("_ok"), F.col("seq"))
    is_d = F.when(F.col("op") == "D", F.col("seq"))
    rows = df.withColumn("_chunk", (F.col("seq") / F.lit(chunk_span)).cast("long"))
    ck = key + ["_chunk"]
    summary = rows.groupBy(*ck).agg(F.max(is_i).alias("_ci"), F.max(is_d).alias("_cd"))
    before_chunk = (Window.partitionBy(*key).orderBy("_chunk")
                    .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(*ck, F.max("_ci").over(before_chunk).alias("_carry_i"),
                           F.max("_cd").over(before_chunk).alias("_carry_d"))
    before_row = (Window.partitionBy(*ck).orderBy("seq")
                  .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(carry, ck, "left")
            .withColumn("prior_i", F.greatest(F.col("_carry_i"), F.max(is_i).over(before_row)))
            .withColumn("prior_d", F.greatest(F.col("_carry_d"), F.max(is_d).over(before_row)))
            .drop("_chunk", "_carry_i", "_carry_d"))


def fold_outcomes(changes: DataFrame, valid: F.Column | None = None, key: list[str] = KEY,
                  chunk_span: int = CHUNK_SPAN) -> DataFrame:
    """I4: the outcome of every change. Rows where ``valid`` is false are
    'rejected' and take no part in the fold (an I or U with a payload the
    checks refuse). Keeps all input columns, adds ``outcome``."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    marked = changes.withColumn("_ok", (F.col("op") == "D") | ok)
    folded = _prior_max(marked, key, chunk_span)
    live = F.coalesce(F.col("prior_i"), F.lit(-1)) > F.coalesce(F.col("prior_d"), F.lit(-1))
    op = F.col("op")
    outcome = (F.when(~F.col("_ok"), "rejected")
               .when(op == "I", F.when(live, "duplicate").otherwise("created"))
               .when(op == "U", F.when(live, "updated").otherwise("not_found"))
               .otherwise(F.when(live, "deleted").otherwise("not_found")))
    return folded.withColumn("outcome", outcome).drop("prior_i", "prior_d", "_ok")


def live_state(outcomes: DataFrame, payload: list[str], key: list[str] = KEY) -> DataFrame:
    """The live row of every key after the whole feed.

    A key is live when its last accepted I is later than its last D; its
    row is the payload of the latest created/updated change, ``born`` the
    seq of the insert that created it (its ts becomes ``created_at``) and
    ``seq`` the seq of its latest change. One aggregate per key (partial
    aggregation), no per-key sort.
    """
    accepted = F.col("outcome") != "rejected"
    changed = F.col("outcome").isin("created", "updated")
    agg = (outcomes.groupBy(*key).agg(
        F.max(F.when(accepted & (F.col("op") == "I"), F.col("seq"))).alias("_last_i"),
        F.max(F.when(F.col("op") == "D", F.col("seq"))).alias("_last_d"),
        F.max_by(F.struct(F.col("seq").alias("born"), F.col("ts").alias("created_at")),
                 F.when(F.col("outcome") == "created", F.col("seq"))).alias("_born"),
        F.max_by(F.struct(*[F.col(c) for c in payload], F.col("seq")),
                 F.when(changed, F.col("seq"))).alias("_row")))
    live = F.coalesce(F.col("_last_i"), F.lit(-1)) > F.coalesce(F.col("_last_d"), F.lit(-1))
    return agg.filter(live).select(*key, "_row.*", "_born.born", "_born.created_at")


# What a trade change carries besides its key, seq and op.
TRADE_PAYLOAD = ["date", "type", "entry_price", "exit_price", "position_size", "pnl", "grade", "notes", "mental",
                 "initial_risk", "account_ids"]


def checked_changes(changes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The feed with whole trades: B6 for changes that send only a PnL (entry
    100, exit 100 +- PnL, size 1), then the same checks, defaults and PnL as
    batch ingest (B1-B5). Adds ``ok`` (a delete or a purge needs no payload) and
    ``reasons``. Columns that the feed lacks count as not sent."""
    df = changes
    for f in TRADE_CHANGES:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    only = F.col("entry_price").isNull() & F.col("exit_price").isNull()
    pnl = number_in(changes, "pnl_input") if "pnl_input" in changes.columns else F.col("pnl_input")
    base = dec(PNL_ONLY_ENTRY_PRICE).cast(MONEY)
    moved = F.when(F.col("type") == "LONG", base + pnl).otherwise(base - pnl).cast(MONEY)
    df = df.withColumns({
        "entry_price": F.when(only & pnl.isNotNull(), base).otherwise(F.col("entry_price")),
        "exit_price": F.when(only, moved).otherwise(F.col("exit_price")),
        "position_size": F.when(only, dec(1).cast(MONEY)).otherwise(F.col("position_size")),
    })
    checked = with_defaults(check_entries(df, users))
    return checked.withColumn("ok", F.col("op").isin("D", "P") | F.col("valid")).select(
        "seq", "op", *KEY, "ts", *TRADE_PAYLOAD, "ok", "reasons")


def change_outcomes(changes: DataFrame, users: DataFrame | None = None, chunk_span: int = CHUNK_SPAN) -> DataFrame:
    """I4 over a trade change feed."""
    checked = checked_changes(changes, users)
    return fold_outcomes(checked, F.col("ok"), KEY, chunk_span)


def live_rows(checked: DataFrame, payload: list[str] = TRADE_PAYLOAD) -> DataFrame:
    """The ledger (or the accounts, by their payload) after the checked changes, in whatever order they came.

    By seq, a key is live from the first accepted insert after its last delete
    (``born``; its ts is ``created_at``); its row is the latest accepted update
    after that, or the insert itself. Two grouped aggregates on the key, both
    with partial aggregation; no outcomes and no per-key sort are needed."""
    rows = checked.filter("ok")
    last_d = rows.filter("op = 'D'").groupBy(*KEY).agg(F.max("seq").alias("last_d"))
    after = rows.filter("op <> 'D'").join(last_d, KEY, "left").filter(F.col("last_d").isNull() | (F.col("seq") > F.col("last_d")))
    columns = [*KEY, *payload, "born", "seq", "created_at"]
    whole = F.struct("seq", *payload)
    ins, upd = F.when(F.col("op") == "I", F.col("seq")), F.when(F.col("op") == "U", F.col("seq"))
    agg = after.groupBy(*KEY).agg(F.min(ins).alias("born"), F.min_by("ts", ins).alias("created_at"),
                                  F.min_by(whole, ins).alias("first"), F.max_by(whole, upd).alias("last"))
    row = F.when(F.col("last.seq") > F.col("born"), F.col("last")).otherwise(F.col("first"))
    return agg.filter(F.col("born").isNotNull()).withColumn("row", row).select(*KEY, "row.*", "born", "created_at").select(*columns)


def live_ledger(changes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """I1-I3 over a feed: every ledger column, with born and seq."""
    return live_rows(checked_changes(changes, users))


# ---- accounts (I5) ---------------------------------------------------------

ACCOUNT_PAYLOAD = ["name", "type", "size"]


def account_state(changes: DataFrame, chunk_span: int = CHUNK_SPAN) -> DataFrame:
    """Account changes (seq, op, user_id, id, name, type, size) with the
    B8 rules; an I or U without a name is rejected. Deleting an account
    leaves its id in trades."""
    return live_state(account_outcomes(changes, chunk_span), ACCOUNT_PAYLOAD).select(*KEY, "name", "type", "size")


def account_outcomes(changes: DataFrame, chunk_span: int = CHUNK_SPAN) -> DataFrame:
    """The outcome of every account change, with the normalised fields."""
    norm = normalise_accounts(changes)
    return fold_outcomes(norm, F.col("valid"), KEY, chunk_span)


def checked_accounts(changes: DataFrame) -> DataFrame:
    """Account changes with the B8 rules and ``ok``, as the live state takes them."""
    norm = normalise_accounts(changes)
    return norm.withColumn("ok", (F.col("op") == "D") | F.col("valid")).select("seq", "op", *KEY, "ts", *ACCOUNT_PAYLOAD, "ok")


def account_changes_from_events(ev: DataFrame) -> DataFrame:
    """A feed of account edits derived from events: signup = create,
    error = delete, else edit; names padded with spaces, some missing; type
    text not always valid; size sometimes not a number."""
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("seq"), F.col("ts"),
        F.when(et == "signup", "I").when(et == "error", "D").otherwise("U").alias("op"),
        F.col("user_id"),
        (F.col("user_id") * 3 + F.col("event_id") % 3).alias("id"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("  "), et, F.lit("-"), (F.col("event_id") % 7).cast("string"),
                             F.lit(" "))).alias("name"),
        F.when(et == "purchase", "prop").when(et == "click", "live").otherwise("PROP").alias("type"),
        F.when(et == "view", F.lit("n/a"))
         .otherwise(F.round(F.col("value") * 1000, 2).cast("decimal(18,2)").cast("string"))
         .alias("size"),
    )


# ---- users (I6) --------------------------------------------------------------

def purge_users(trades: DataFrame, purged: DataFrame) -> DataFrame:
    """Removing a user removes their trades (``purged`` has user_id).
    The purge list is broadcast under a checked bound."""
    return trades.join(bounded_broadcast(purged.select("user_id")), "user_id", "left_anti")
