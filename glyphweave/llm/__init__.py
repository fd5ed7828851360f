"""Operators for preparing large text corpora: deduplication, filters, tokens and packing."""
