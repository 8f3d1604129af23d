"""Whole jobs: the batch ingest, the derived test tables and the query registry."""
