"""Operators of a training-data pipeline: scans, filters, scores, near-duplicates, token files."""
