"""Incremental versions of stock and movement counts."""
