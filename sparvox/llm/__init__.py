"""Operators of a training-data pipeline: quality, dedup, archives, tokenisers, scoring, search and mixing."""
