"""Operators of a training-data pipeline: filtering, deduplication, mixing, sharding, archives and token files."""
