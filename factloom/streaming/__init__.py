"""Ingest of feeds, in batches or as streams."""
