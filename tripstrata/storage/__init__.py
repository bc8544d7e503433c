"""Stored layers: Parquet folders replaced one partition directory at a time."""
