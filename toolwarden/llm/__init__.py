"""Operators for training-data corpora: extraction, privacy, duplicates, search, sharding, packing, tokens, toxicity, quality."""
