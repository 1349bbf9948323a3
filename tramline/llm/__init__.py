"""Operators for preparing training text: filters, deduplication, scoring, packing, search."""
