"""Operators for preparing training data: deduplication, tokens, filters, packing, search."""
