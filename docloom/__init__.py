"""docloom - document catalog, delta ingest and keyword search as Spark jobs."""
