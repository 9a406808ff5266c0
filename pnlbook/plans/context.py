"""The journal tables over one test-data folder, built lazily."""

from __future__ import annotations

import weakref
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pnlbook.operators.ingest import ingest
from pnlbook.sources import fixtures
from pnlbook.sources.ledger import read_ledger


class Journal:
    """users, accounts, raw_trades, trades and trade_changes of ``sf_dir``.

    Nothing is read until a frame is used; each property returns the same
    DataFrame object, so one query reuses one plan (and Spark reuses the
    exchange when the same subtree appears twice).
    """

    _open: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Journal":
        """The session's Journal for ``sf_dir``, built once and then reused,
        so the ingest plan and its broadcast check are not redone for every
        result asked of the same (read-only) folder."""
        per_session = cls._open.setdefault(spark, {})
        if sf_dir not in per_session:
            per_session[sf_dir] = cls(spark, sf_dir)
        return per_session[sf_dir]

    def __init__(self, spark: SparkSession, sf_dir: str, ledger_path: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.ledger_path = ledger_path

    @cached_property
    def users(self) -> DataFrame:
        return fixtures.users(self.spark, self.sf_dir)

    @cached_property
    def accounts(self) -> DataFrame:
        return fixtures.accounts(self.spark, self.sf_dir)

    @cached_property
    def raw_trades(self) -> DataFrame:
        return fixtures.raw_trades(self.spark, self.sf_dir)

    @cached_property
    def trades(self) -> DataFrame:
        """The clean ledger: read from ``ledger_path`` when one was written
        (ingest once, query many times; its ``month`` column lets the date
        filters skip month folders), else checked from raw entries."""
        if self.ledger_path:
            return read_ledger(self.spark, self.ledger_path)
        return ingest(self.raw_trades, self.users)

    @cached_property
    def trade_changes(self) -> DataFrame:
        return fixtures.trade_changes(self.spark, self.sf_dir)
