"""Operators for training text: deduplication, filtering, search, archives, packing."""
