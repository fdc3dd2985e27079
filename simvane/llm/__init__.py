"""Operators of a training-data pipeline: scoring, cleaning, near-duplicates, mixing, tokenizing."""
