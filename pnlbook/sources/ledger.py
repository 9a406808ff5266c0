"""The ledger on storage (A1, A4) and trade entries as JSON (A3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pnlbook.functions.text import month_key
from pnlbook.operators.filters import by_id, by_user, date_range
from pnlbook.operators.ingest import NUMBER_PREFIX, leading_number
from pnlbook.schemas import MONEY, RAW_TRADES_JSON, TRADES

LEDGER_SCHEMA = TRADES.add("month", "string")
BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.enabled#user_id": "true"}
MOST_FILES = 10_000     # files that a lookup lists on the driver


def write_ledger(trades: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: the ledger partitioned by month, sorted by (user_id, date) inside.

    The REBALANCE hint lets AQE split a month that is much larger than the
    others into several files instead of one task; the sort gives tight
    row-group min/max on user_id and date for later reads.
    """
    (trades.withColumn("month", month_key(F.col("date")))
     .hint("rebalance", "month")
     .sortWithinPartitions("month", "user_id", "date")
     .write.mode(mode).partitionBy("month").options(**BLOOM).parquet(path))


def index_ledger(spark: SparkSession, path: str) -> None:
    """A4's index: beside the ledger, a manifest with the least and greatest
    user_id, id and date of each file (three columns are read, one row a file made).
    Write it again after each append."""
    rows = read_ledger(spark, path).select(F.col("_metadata.file_path").alias("file"), "user_id", "id", "date")
    edges = [f(c).alias(f"{n}_{c}") for c in ("user_id", "id", "date") for n, f in (("least", F.min), ("most", F.max))]
    rows.groupBy("file").agg(F.count(F.lit(1)).alias("trades"), *edges).coalesce(1).write.mode("overwrite").parquet(f"{path}.manifest")


def find_trades(spark: SparkSession, path: str, user_id: int, trade_id: int | None = None, date_from=None, date_to=None) -> DataFrame:
    """C1, C2 and C7 over an indexed ledger: only files whose bounds admit the wanted
    rows are opened (their bloom filters then skip row groups). Beyond
    ``MOST_FILES`` the whole ledger is scanned with the same filters."""
    near = spark.read.parquet(f"{path}.manifest").where(F.lit(user_id).between(F.col("least_user_id"), F.col("most_user_id")))
    if trade_id is not None:
        near = near.where(F.lit(trade_id).between(F.col("least_id"), F.col("most_id")))
    if date_from is not None:
        near = near.where(F.col("most_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        near = near.where(F.col("least_date") <= F.lit(date_to).cast("date"))
    files = [r.file for r in near.select("file").limit(MOST_FILES + 1).collect()]
    if len(files) > MOST_FILES:
        df = read_ledger(spark, path, date_from, date_to)
    elif files:
        df = date_range(spark.read.schema(LEDGER_SCHEMA).option("basePath", path).parquet(*files), date_from, date_to)
    else:
        df = spark.createDataFrame([], LEDGER_SCHEMA)
    df = by_user(df, user_id)
    return df if trade_id is None else by_id(df, trade_id, user_id)


def read_ledger(spark: SparkSession, path: str, date_from=None, date_to=None) -> DataFrame:
    """A1: scan the ledger. A date range also bounds ``month``, so whole
    month folders are skipped (partition pruning) besides the pushed-down
    date filter inside the files."""
    df = spark.read.schema(LEDGER_SCHEMA).parquet(path).drop("batch_id")
    return date_range(df, date_from, date_to)


# Bits of ``problems``: what a JSON entry sent that cannot be read.
BAD_JSON, BAD_DATE, BAD_NUMBER, OUT_OF_RANGE, BAD_ID, BAD_USER, BAD_ACCOUNTS, BAD_CREATED = (1 << k for k in range(8))


def _sent(c: str):
    """The text of a field; '' counts as absent."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def account_list(text: Column) -> tuple[Column, Column]:
    """The account ids of a JSON text and whether something else was sent. As a
    VARIANT it tells an array from other values and a null element (left out) from one
    that is no whole number."""
    ids = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    number = lambda x: F.try_variant_get(x, "$", "string").try_cast("int")
    unread = ids.isNull() | F.exists(ids, lambda x: ~F.is_variant_null(x) & number(x).isNull())
    return F.filter(F.transform(ids, number), lambda x: x.isNotNull()), text.isNotNull() & unread


def parse_entries(df: DataFrame) -> DataFrame:
    """B10 on JSON entries (RAW_TRADES_JSON, ``raw`` = the line): dates cut to
    10 characters, numbers from text, '' -> NULL, the risk by its leading
    number. ``problems`` has a bit for each kind of value that was sent but
    cannot be read, and for lines that are not JSON; nothing is dropped and
    nothing raises."""
    money = {c: _sent(c).try_cast(MONEY) for c in ("entry_price", "exit_price", "position_size")}
    date = F.try_to_date(F.substring(_sent("date"), 1, 10))
    risk = leading_number(F.col("initial_risk"))
    created = F.col("created_at").try_cast("timestamp_ntz")
    ids, bad_accounts = account_list(_sent("account_ids"))
    whole = {"id": _sent("id").try_cast("long"), "user_id": _sent("user_id").try_cast("int")}
    unread = [(_sent(c).isNotNull() & v.isNull(), _sent(c).try_cast("double").isNotNull()) for c, v in money.items()]
    unread.append((_sent("initial_risk").isNotNull() & risk.isNull(), _sent("initial_risk").rlike(NUMBER_PREFIX)))
    flag = lambda cond, bit: F.when(cond, F.lit(bit)).otherwise(F.lit(0))
    some = lambda conds: reduce(lambda a, b: a | b, conds)
    problems = (flag(F.col("_corrupt_record").isNotNull(), BAD_JSON) + flag(_sent("date").isNotNull() & date.isNull(), BAD_DATE)
                + flag(some([bad & ~number for bad, number in unread]), BAD_NUMBER)
                + flag(some([bad & number for bad, number in unread]), OUT_OF_RANGE)
                + flag(_sent("id").isNotNull() & whole["id"].isNull(), BAD_ID)
                + flag(_sent("user_id").isNotNull() & whole["user_id"].isNull(), BAD_USER)
                + flag(bad_accounts, BAD_ACCOUNTS) + flag(_sent("created_at").isNotNull() & created.isNull(), BAD_CREATED))
    return df.select(
        *(v.alias(c) for c, v in whole.items()), date.alias("date"), "type",
        *(v.alias(c) for c, v in money.items()), "grade", "mental", risk.alias("initial_risk"),
        "notes", ids.alias("account_ids"), created.alias("created_at"), problems.alias("problems"), "raw")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A3: files of JSON lines; blank lines are skipped."""
    return entries_from_json(spark.read.text(path).where(F.trim("value") != ""))


def entries_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """A3 for a string column (a line or a message): PERMISSIVE ``from_json``.
    A null message is a bad line."""
    parsed = F.from_json(F.coalesce(F.col(column), F.lit("null")), RAW_TRADES_JSON,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    entries = df.select(parsed.alias("_e"), F.col(column).alias("raw")).select("_e.*", "raw")
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in entries.columns if c not in ("raw", "_corrupt_record")])
    return parse_entries(entries.withColumn("_corrupt_record", F.when(empty, F.coalesce("raw", F.lit(""))).otherwise(F.col("_corrupt_record"))))
