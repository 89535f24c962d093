"""Operators of a training-data pipeline: scoring, packing, near-duplicates, fingerprints, tokens."""
