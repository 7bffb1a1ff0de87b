"""Training-data operators: language id, extraction, quality, dedup, packing, PII, mixing, sharding."""
