"""Security-evidence analytics on Spark: ingest, enrich, detect, correlate, report."""
