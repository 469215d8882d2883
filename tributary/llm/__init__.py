"""Training-data operators: quality, formatting, privacy, deduplication, tokenizing, filtering.

Nothing else in the library imports this subpackage.
"""
