"""Operators for training-data pipelines: scans, tokenizers, near-duplicates, quality, mixing, privacy."""
