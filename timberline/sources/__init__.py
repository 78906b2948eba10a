"""Readers and writers: text, CSV, Parquet."""
