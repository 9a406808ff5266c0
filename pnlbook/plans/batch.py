"""Batch jobs that write more than one result from one read."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pnlbook.operators.ingest import TRADE_COLUMNS, check_entries, with_defaults
from pnlbook.sources.ledger import write_ledger


def ingest_to_ledger(raw: DataFrame, users: DataFrame, ledger_path: str, rejects_path: str, batch_id: int = 0) -> None:
    """B1-B5 then A4: clean rows to the month-partitioned ledger, refused rows
    (id, user_id, reasons) to ``rejects_path``.

    A batch has folders of its own (``batch_id=N``) in both, which a rerun of the
    same batch replaces; other batches are never touched. The checked frame is
    persisted (memory, spilling to disk), so the input is read and checked once
    for both sinks; a lost executor's blocks are recomputed from the lineage.
    """
    checked = check_entries(raw, users).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ok = with_defaults(checked.filter(F.col("valid"))).select(*TRADE_COLUMNS)
        write_ledger(ok, f"{ledger_path}/batch_id={batch_id}")
        (checked.filter(~F.col("valid")).select("id", "user_id", "reasons")
         .write.mode("overwrite").parquet(f"{rejects_path}/batch_id={batch_id}"))
    finally:
        checked.unpersist()
