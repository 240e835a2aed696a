"""Operators of a training-data pipeline: rules, secrets, scoring, tokens, mixing, shards, deduplication."""
