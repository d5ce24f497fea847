"""Operators for building training corpora: deduplication, mixing, counting, filtering and extraction."""
