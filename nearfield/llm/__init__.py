"""Training-data operators on Spark: filtering, PII, extraction, scoring, tokenizing, deduplication, sharding."""
