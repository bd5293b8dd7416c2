"""Structured Streaming jobs and the ledger they commit to."""
