"""Operators for training-data corpora: search, filters, dedup, packing, token files, sharding."""
