"""Structured Streaming forms of ingestion and zone totals."""
