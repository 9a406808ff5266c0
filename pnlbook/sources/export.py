"""CSV export (A5): id, date, type, entry_price, exit_price, position_size,
pnl, notes, created_at; a header line; NULL -> empty; every field quoted,
quotes doubled, spaces and new lines inside fields kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pnlbook.functions.text import number_text

CSV_COLUMNS = ("id", "date", "type", "entry_price", "exit_price", "position_size", "pnl",
               "notes", "created_at")
CSV_OPTIONS = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def _text_columns(trades: DataFrame) -> list[Column]:
    as_text = {
        "id": F.col("id").cast("string"),
        "date": F.date_format(F.col("date"), "yyyy-MM-dd"),
        "pnl": number_text(F.col("pnl")),
        "created_at": F.date_format(F.col("created_at"), "yyyy-MM-dd HH:mm:ss"),
    }
    return [F.coalesce(as_text.get(c, F.col(c).cast("string")), F.lit("")).alias(c)
            for c in CSV_COLUMNS]


def csv_lines(trades: DataFrame) -> DataFrame:
    """One CSV line per trade (id, line), the same text the file has."""
    cols = _text_columns(trades)
    return trades.select(F.col("id"), F.to_csv(F.struct(*cols), CSV_OPTIONS).alias("line"))


def write_csv(trades: DataFrame, path: str) -> None:
    """Write the export as part files, one per task (each with its header
    line); the rows are never funnelled through a single task."""
    out = trades.select(*_text_columns(trades))
    (out.write.mode("overwrite").options(**CSV_OPTIONS).option("header", "true")
     .csv(path))
