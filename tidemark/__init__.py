"""Change-data analytics on Spark: ingest, version journals, dimensions, marts, checks and panels."""
