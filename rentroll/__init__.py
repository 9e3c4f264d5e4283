"""Property-rental bookkeeping on Spark: ingest, key, derive and report ledgers."""
