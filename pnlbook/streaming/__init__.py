"""Structured Streaming forms of ingest, daily summary and the ledger."""
