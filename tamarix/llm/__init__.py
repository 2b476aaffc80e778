"""Operators of a training-data pipeline: sharding, packing, near-duplicates, tokens, personal data, search, urls, toxicity."""
