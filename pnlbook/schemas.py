"""Explicit schemas of the ledger tables and the raw entries."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)      # prices, sizes, PnL, account sizes
TOTAL = T.DecimalType(28, 4)      # sums of money: 10 more digits than one amount
RATE = T.DecimalType(6, 1)        # win rate (percent, 1 place)
SHARE = T.DecimalType(32, 1)      # best day / net in percent; has no upper bound
FACTOR = T.DecimalType(30, 2)     # profit factor, averages, R multiple
SCORE = T.DecimalType(10, 4)      # edge scores 0..100

USERS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("username", T.StringType(), False),
])

ACCOUNTS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("user_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("size", MONEY, True),
])

# One trade entry as a client sends it (fields may be missing or dirty).
RAW_TRADES = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("user_id", T.IntegerType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("entry_price", MONEY, True),
    T.StructField("exit_price", MONEY, True),
    T.StructField("position_size", MONEY, True),
    T.StructField("grade", T.StringType(), True),
    T.StructField("mental", T.StringType(), True),
    T.StructField("initial_risk", MONEY, True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("account_ids", T.ArrayType(T.IntegerType()), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

# The same entry as JSON text: every scalar is read as text, so one field of an
# unexpected type does not spoil its line.
RAW_TRADES_JSON = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("entry_price", T.StringType(), True),
    T.StructField("exit_price", T.StringType(), True),
    T.StructField("position_size", T.StringType(), True),
    T.StructField("grade", T.StringType(), True),
    T.StructField("mental", T.StringType(), True),
    T.StructField("initial_risk", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("account_ids", T.StringType(), True),         # the value's JSON text
    T.StructField("created_at", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])

TRADES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.IntegerType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("entry_price", MONEY, False),
    T.StructField("exit_price", MONEY, False),
    T.StructField("position_size", MONEY, False),
    T.StructField("pnl", MONEY, False),
    T.StructField("grade", T.StringType(), True),
    T.StructField("notes", T.StringType(), False),
    T.StructField("mental", T.StringType(), True),
    T.StructField("initial_risk", MONEY, True),
    T.StructField("account_ids", T.ArrayType(T.IntegerType()), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

# A change as a client sends it: the trade's fields, or only its PnL.
TRADE_CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("op", T.StringType(), False),
    T.StructField("user_id", T.IntegerType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("entry_price", MONEY, True),
    T.StructField("exit_price", MONEY, True),
    T.StructField("position_size", MONEY, True),
    T.StructField("pnl_input", MONEY, True),
    T.StructField("grade", T.StringType(), True),
    T.StructField("mental", T.StringType(), True),
    T.StructField("initial_risk", MONEY, True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("account_ids", T.ArrayType(T.IntegerType()), True),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])
