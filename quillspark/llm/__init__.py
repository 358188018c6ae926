"""Operators of a training-data pipeline: search, redaction, packing, scoring, deduplication, formatting, tokenising, extraction."""
