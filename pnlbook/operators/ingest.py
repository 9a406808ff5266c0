"""Ingest of trade entries: checks, defaults, PnL.

``check_entries`` adds ``valid`` and ``reasons`` (the failed checks, NULL
when the entry passes; built from one integer of fault bits) to every entry; ``ingest`` keeps the valid rows as
the ledger, ``rejects`` the others. Both come from one plan, so persisting
the checked frame lets a job write both sinks from a single scan
(``plans.batch.ingest_to_ledger``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pnlbook.functions.money import dec, pnl_of
from pnlbook.plans.joins import bounded_broadcast
from pnlbook.schemas import MONEY

SIDES = ("LONG", "SHORT")
MAX_GRADE_LEN = 3
ACCOUNT_TYPES = ("live", "prop")
DEFAULT_ACCOUNT_TYPE = "live"
PNL_ONLY_ENTRY_PRICE = 100   # the form stores entry 100, exit 100 +- pnl, size 1

# Reason codes, in the order they are listed.
REASONS = ("missing_date", "missing_type", "missing_entry_price", "missing_exit_price",
           "bad_type", "bad_grade", "out_of_range", "unknown_user", "bad_json", "bad_date", "bad_number")

TRADE_COLUMNS = ("id", "user_id", "date", "type", "entry_price", "exit_price",
                 "position_size", "pnl", "grade", "notes", "mental", "initial_risk",
                 "account_ids", "created_at")


def size_or_one(size: Column) -> Column:
    """Position size: NULL or 0 means 1."""
    return F.coalesce(F.nullif(size, dec(0)), dec(1)).cast(MONEY)


def with_defaults(df: DataFrame) -> DataFrame:
    """B2: size NULL/0 -> 1, notes NULL -> '', grade and mood '' -> NULL,
    risk 0 -> NULL, account list NULL -> empty."""
    return df.withColumns({
        "position_size": size_or_one(F.col("position_size")),
        "grade": F.nullif(F.col("grade"), F.lit("")),
        "notes": F.coalesce(F.col("notes"), F.lit("")),
        "mental": F.nullif(F.col("mental"), F.lit("")),
        "initial_risk": F.nullif(F.col("initial_risk"), dec(0)).cast(MONEY),
        "account_ids": F.coalesce(F.col("account_ids"), F.array().cast("array<int>")),
    })


def with_pnl(df: DataFrame) -> DataFrame:
    """B1: PnL from side, prices and (defaulted) size."""
    return df.withColumn("pnl", pnl_of(F.col("type"), F.col("entry_price"),
                                       F.col("exit_price"), size_or_one(F.col("position_size"))))


def check_entries(raw: DataFrame, users: DataFrame | None) -> DataFrame:
    """Add ``pnl``, ``valid`` and ``reasons`` (comma list of the
    failed checks; NULL for a valid row). The clean path filters on the
    boolean, so no text is built for the rows that pass.

    An id listed twice in ``users`` counts once. The users side is broadcast
    only under a checked size; otherwise this is a shuffle join on user_id.

    Entries read from JSON bring ``problems`` (bits of what could not be read,
    see ``sources.ledger``): a value that was sent but cannot be read refuses
    the entry instead of becoming a default, and a line that is not JSON is
    refused as ``bad_json`` alone.
    """
    if users is None:               # no user list: all users count as known
        df = with_pnl(raw).withColumn("_known", F.lit(True))
    else:
        known = bounded_broadcast(users.select(F.col("id").alias("user_id")).distinct()
                                  .withColumn("_known", F.lit(True)))
        df = with_pnl(raw).join(known, "user_id", "left")
    from_json = "problems" in raw.columns
    problem = lambda bit: (F.col("problems").bitwiseAND(bit) != 0) if from_json else F.lit(False)
    side_ok = F.col("type").isin(*SIDES)
    no_side = F.col("type").isNull() | (F.col("type") == "")     # '' counts as missing
    checks = [
        (F.col("date").isNull() & ~problem(2), "missing_date"),
        (no_side, "missing_type"),
        (F.col("entry_price").isNull(), "missing_entry_price"),
        (F.col("exit_price").isNull(), "missing_exit_price"),
        (~no_side & ~side_ok, "bad_type"),
        (F.length(F.col("grade")) > MAX_GRADE_LEN, "bad_grade"),
        (side_ok & F.col("entry_price").isNotNull() & F.col("exit_price").isNotNull()
         & F.col("pnl").isNull() | problem(8), "out_of_range"),
        (F.col("_known").isNull() & ~problem(32), "unknown_user"),
    ]
    if from_json:
        checks = [(~problem(1) & cond, code) for cond, code in checks]
        checks += [(problem(1), "bad_json"), (~problem(1) & problem(2), "bad_date"), (~problem(1) & problem(4), "bad_number")]
        checks += [(~problem(1) & problem(bit), code) for bit, code in
                   ((16, "bad_id"), (32, "bad_user_id"), (64, "bad_accounts"), (128, "bad_created_at"))]
    # One integer of fault bits. It is a single expression over both join
    # sides, so Catalyst keeps it above the join instead of splitting it and
    # pushing copies of the PnL arithmetic below; valid rows build no text.
    faults = reduce(lambda a, b: a + b,
                    [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)) for i, (cond, _) in enumerate(checks)])
    reasons = F.concat_ws(",", *[F.when(F.col("_faults").bitwiseAND(1 << i) != 0, F.lit(code))
                                 for i, (_, code) in enumerate(checks)])
    return (df.withColumn("_faults", faults)
            .withColumn("valid", F.col("_faults") == 0)
            .withColumn("reasons", F.when(~F.col("valid"), reasons))
            .drop("_known", "_faults"))


def ingest(raw: DataFrame, users: DataFrame) -> DataFrame:
    """raw entries -> clean ledger rows (the trades table)."""
    ok = check_entries(raw, users).filter(F.col("valid"))
    return with_defaults(ok).select(*TRADE_COLUMNS)


def rejects(raw: DataFrame, users: DataFrame) -> DataFrame:
    """The refused entries with their reasons; of lines that are not JSON, their text."""
    bad = check_entries(raw, users).filter(~F.col("valid"))
    if "problems" not in raw.columns:
        return bad.select("id", "reasons")
    return bad.select("id", "reasons", F.when(F.col("problems").bitwiseAND(1) != 0, F.col("raw")).alias("raw"))


def orphans(raw: DataFrame, users: DataFrame) -> DataFrame:
    """Entries whose user does not exist (left anti join)."""
    ids = bounded_broadcast(users.select(F.col("id").alias("user_id")))
    return raw.join(ids, "user_id", "left_anti")


# Leading number of a text, as a number parser that stops at the first
# character that cannot continue it ('12.5abc' -> 12.5, 'abc' -> none).
NUMBER_PREFIX = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def leading_number(text: Column) -> Column:
    """The numeric prefix of a text (after leading spaces) as DECIMAL(18,4),
    NULL when there is none."""
    return F.regexp_extract(F.ltrim(text), NUMBER_PREFIX, 0).try_cast(MONEY)


def number_in(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as DECIMAL(18,4): text by its leading
    number (as a form's number parser reads it), numbers by a plain cast."""
    if dict(df.dtypes).get(name) == "string":
        return leading_number(F.col(name))
    return F.col(name).try_cast(MONEY)


def pnl_only_entries(entries: DataFrame) -> DataFrame:
    """B6 + B7: entries that carry only a PnL (``pnl_input``).

    Rows with no date or no number are dropped (the form refuses them);
    notes are trimmed; entry 100, exit 100 + pnl (LONG) or 100 - pnl,
    size 1; then the usual PnL rule.
    """
    pnl_in = number_in(entries, "pnl_input")
    base = dec(PNL_ONLY_ENTRY_PRICE).cast(MONEY)
    out = (entries.filter(F.col("date").isNotNull() & pnl_in.isNotNull())
           .withColumns({
               "entry_price": base,
               "exit_price": F.when(F.col("type") == "LONG", base + pnl_in)
                              .otherwise(base - pnl_in).cast(MONEY),
               "position_size": dec(1).cast(MONEY),
           }))
    if "notes" in entries.columns:
        out = out.withColumn("notes", F.trim(F.col("notes")))
    return with_pnl(out)


def normalise_accounts(df: DataFrame) -> DataFrame:
    """A name is required (NULL or '' refuses the row; the check is on
    the name as sent, then it is stored trimmed); type live/prop else live;
    size the leading number of the text, else 0. Adds ``valid``."""
    raw_name = F.col("name")
    size = F.coalesce(leading_number(F.col("size").cast("string")), dec(0).cast(MONEY))
    return df.withColumns({
        "name": F.trim(raw_name),
        "type": F.when(F.col("type").isin(*ACCOUNT_TYPES), F.col("type"))
                 .otherwise(F.lit(DEFAULT_ACCOUNT_TYPE)),
        "size": size,
        "valid": F.coalesce(raw_name != "", F.lit(False)),
    })


def default_account_pairs(entries: DataFrame, accounts: DataFrame,
                          active_account: int | None = None) -> DataFrame:
    """B9 as (entry, account) rows: an entry with no account list (NULL)
    goes to the active account, or else to every account of its user; an
    entry with a list goes to each listed account (an empty list to none).

    Filling "all accounts" is a join on user_id, not a collected list: the
    accounts side is broadcast when a count bounds it, otherwise a shuffle
    join whose hot users AQE splits; no user's entries are gathered into
    one array or one task.
    """
    keep = [c for c in entries.columns if c != "account_ids"]
    listed = (entries.filter(F.col("account_ids").isNotNull())
              .select(*keep, F.explode(F.array_distinct("account_ids")).alias("account_id")))
    missing = entries.filter(F.col("account_ids").isNull()).drop("account_ids")
    if active_account is not None:
        filled = missing.withColumn("account_id", F.lit(active_account).cast("int"))
    else:
        acct = accounts.select("user_id", F.col("id").cast("int").alias("account_id"))
        filled = missing.join(bounded_broadcast(acct), "user_id")
    return listed.unionByName(filled)


def load_projection(df: DataFrame) -> DataFrame:
    """Text dates cut to 10 characters, PnL text to a decimal."""
    out = df
    if dict(df.dtypes).get("date") == "string":
        out = out.withColumn("date", F.try_to_date(F.substring(F.col("date"), 1, 10)))
    if dict(df.dtypes).get("pnl") == "string":
        out = out.withColumn("pnl", F.col("pnl").try_cast(MONEY))
    return out


def new_users(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Names not taken yet (a missing or empty name is refused); of
    repeats in the batch the first (by ``seq``) wins. ``existing`` has
    ``username``.

    The first row per name is ``min(seq)`` plus one ``min_by`` per other
    column, so a name repeated very often is reduced map-side before the
    shuffle (a hash aggregate when those columns are fixed-width).
    """
    taken = existing.select("username").dropDuplicates()
    rest = [c for c in candidates.columns if c != "username"]
    named = candidates.filter(F.col("username").isNotNull() & (F.col("username") != ""))
    firsts = [F.min("seq").alias("seq")] + [F.min_by(F.col(c), F.col("seq")).alias(c)
                                             for c in rest if c != "seq"]
    return (named.join(taken, "username", "left_anti")
            .groupBy("username").agg(*firsts)
            .select("username", *rest))
