"""Ingest of files, in batches or as a stream."""
