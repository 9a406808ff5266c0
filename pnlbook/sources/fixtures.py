"""Journal tables derived from the given TPC-H-style tables.

users      <- nation            (25 users, and one more who never trades)
accounts   <- nation x {0,1,2}  (3 accounts per user)
raw_trades <- orders JOIN customer, with faults planted on purpose
trade_changes <- events         (a change feed: I / U / D rows)

The planted faults (bad side, missing price, unknown user, empty or zero
fields, empty account lists) exercise every check of the ingest step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pnlbook.schemas import MONEY
from pnlbook.sources.tables import read_table

# Fixed values of the fixture definition.
UNKNOWN_USER = 99          # planted user id that has no users row
NO_TRADE_USER = (25, "NO_TRADES")   # a user with accounts and no customers, so no trades
PRIORITY_GRADE = {"1-URGENT": "A+", "2-HIGH": "A", "3-MEDIUM": "B", "4-NOT SPECIFIED": "C"}
LONG_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
SEGMENT_MOOD = {"AUTOMOBILE": "angry", "BUILDING": "frustrated", "FURNITURE": "neutral",
                "HOUSEHOLD": "sad"}
OTHER_MOOD = "happy"
ACCOUNTS_PER_USER = 3
ACCOUNT_UNIT_SIZE = 25000


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    idle, name = NO_TRADE_USER
    one = spark.range(1).select(F.lit(idle).cast("int").alias("id"), F.lit(name).alias("username"))
    return n.select(F.col("n_nationkey").cast("int").alias("id"),
                    F.col("n_name").alias("username")).unionByName(one)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return (users(spark, sf_dir).select(F.col("id").alias("owner"), "username",
                     F.explode(F.sequence(F.lit(0), F.lit(ACCOUNTS_PER_USER - 1))).alias("k"))
            .select((F.col("owner") * ACCOUNTS_PER_USER + k).cast("int").alias("id"),
                    F.col("owner").alias("user_id"),
                    F.concat(F.col("username"), F.lit("-"), k.cast("string")).alias("name"),
                    F.when(k == 2, F.lit("prop")).otherwise(F.lit("live")).alias("type"),
                    (F.lit(ACCOUNT_UNIT_SIZE) * (k + 1)).cast(MONEY).alias("size"),
                    # not in the order of the ids, and with ties
                    F.date_add(F.lit("2020-01-01").cast("date"), (F.col("owner") * 5 + k * 4) % 7).cast("timestamp_ntz").alias("created_at")))


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order = one trade entry, before any check.

    The derivation is a single projection of SQL expressions over the
    join, so the plan is built with a handful of calls.
    """
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    b = o.join(c, o["o_custkey"] == c["c_custkey"])
    grade = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_GRADE.items())
    mood = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_MOOD.items())
    longs = ", ".join(f"'{p}'" for p in LONG_PRIORITIES)
    price = "CAST(100 + o_custkey % 50 AS DECIMAL(18,4))"
    user = f"CAST(CASE WHEN o_orderkey % 97 = 0 THEN {UNKNOWN_USER} ELSE c_nationkey END AS INT)"
    acct = ", ".join(f"CASE WHEN (o_orderkey % 8) & {1 << k} <> 0 THEN {user} * "
                     f"{ACCOUNTS_PER_USER} + {k} END" for k in range(ACCOUNTS_PER_USER))
    return b.selectExpr(
        "o_orderkey AS id",
        f"{user} AS user_id",
        "CAST(o_orderdate AS DATE) AS date",
        f"CASE WHEN o_orderkey % 89 = 0 THEN 'FLAT' WHEN o_orderpriority IN ({longs}) THEN 'LONG' "
        "ELSE 'SHORT' END AS type",
        f"CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE {price} END AS entry_price",
        f"CAST({price} + CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 201 - 100 AS DECIMAL(10,4))"
        " * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS exit_price",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_orderkey % 5 AS DECIMAL(10,4)) "
        "* CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,4)) END AS position_size",
        f"CASE o_orderpriority {grade} ELSE '' END AS grade",
        f"CASE c_mktsegment {mood} ELSE '{OTHER_MOOD}' END AS mental",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS DECIMAL(18,4)) END "
        "AS initial_risk",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('  note \"', o_orderpriority, "
        "'\", seg ', c_mktsegment, ' ') END AS notes",
        f"filter(array({acct}), x -> x IS NOT NULL) AS account_ids",
        "o_orderdate AS created_at",
    )


def entries_json(raw: DataFrame) -> DataFrame:
    """The entries as JSON text, with faults planted by id: every second one
    sends its user id as text; some lines are cut off (101), some have a date
    in another format (103), a size that is no number (107) or that no column
    holds (109), an id (113), a user id (127) or an account (131) that is no number, a risk
    that is none (137) or too large (139), or a time that is none (149)."""
    cols = {c: F.col(c) for c in raw.columns}
    size = (F.when(F.col("id") % 107 == 0, "abc").when(F.col("id") % 109 == 0, "99999999999999999999")
            .otherwise(F.col("position_size").cast("string")))
    date = F.when(F.col("id") % 103 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string"))
    fault = lambda mod, value, other: F.when(F.col("id") % mod == 0, value).otherwise(other)
    as_text = lambda c: F.col(c).cast("string")
    cols |= {"position_size": size, "date": date, "id": fault(113, F.concat(F.lit("n"), as_text("id")), as_text("id")),
             "account_ids": fault(131, F.array(F.lit("x"), F.lit("5")), F.col("account_ids").cast("array<string>")),
             "initial_risk": fault(137, F.lit("abc"), fault(139, F.lit("99999999999999999999"), as_text("initial_risk"))),
             "created_at": fault(149, F.lit("nonsense"), as_text("created_at"))}
    cols["user_id"] = fault(127, F.concat(F.lit("u"), as_text("user_id")), as_text("user_id"))
    text = lambda c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    whole = F.when((F.col("id") % 2 == 0) | (F.col("id") % 127 == 0), text(cols)).otherwise(text(cols | {"user_id": F.col("user_id")}))
    cut = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"user_id":'))
    return raw.select(F.when(F.col("id") % 101 == 0, cut).otherwise(whole).alias("value"))


def trade_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_from_events(read_table(spark, sf_dir, "events", "event_id", "ts", "user_id",
                                          "event_type", "value", "props"))


def changes_from_events(ev: DataFrame) -> DataFrame:
    """events -> trade change feed; seq = event_id is the arrival order.

    Every third change sends a whole trade, the others only a PnL (some of
    them nothing); some sides are bad, some grades too long, and user 26 is
    unknown."""
    user = "CAST(user_id % 27 AS INT)"
    whole = "event_id % 3 = 0"
    price = "CAST(100 + user_id % 50 AS DECIMAL(18,4))"
    return ev.selectExpr(
        "event_id AS seq", "ts",
        "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op",
        f"{user} AS user_id", "user_id * 10 + event_id % 10 AS id", "CAST(ts AS DATE) AS date",
        "CASE WHEN event_id % 41 = 0 THEN 'FLAT' WHEN event_type IN ('click', 'signup') THEN 'LONG' ELSE 'SHORT' END AS type",
        f"CASE WHEN {whole} THEN {price} END AS entry_price",
        f"CASE WHEN {whole} THEN CAST({price} + CAST(value AS DECIMAL(12,4)) AS DECIMAL(18,4)) END AS exit_price",
        f"CASE WHEN {whole} THEN CAST(CAST(event_id % 4 AS DECIMAL(10,4)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,4)) END AS position_size",
        f"CASE WHEN NOT {whole} AND event_id % 53 <> 0 THEN CAST(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS DECIMAL(18,4)) END AS pnl_input",
        "CASE WHEN event_id % 59 = 0 THEN 'AAAA' WHEN event_id % 5 = 0 THEN '' ELSE 'A' END AS grade",
        "CASE WHEN event_id % 6 = 0 THEN 'happy' END AS mental",
        "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 30 AS DECIMAL(18,4)) END AS initial_risk",
        "CASE WHEN event_id % 2 = 0 THEN concat(' n', CAST(event_id AS STRING)) END AS notes",
        f"CASE WHEN event_id % 5 <> 0 THEN array({user} * 3) END AS account_ids")
