"""Corpus screening on Spark: scopes, fragments, batches, two screeners, arbitration, final records."""
