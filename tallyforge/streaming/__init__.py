"""Incremental evaluation of prediction files as they arrive."""
