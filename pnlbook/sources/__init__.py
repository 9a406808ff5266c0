"""Readers and writers: parquet tables, JSON entries, ledger, CSV."""
