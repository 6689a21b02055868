"""Training-data operators: scoring, filtering, deduplication, encoding, sharding."""
