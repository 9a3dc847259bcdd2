"""Operators for preparing training text: deduplication, scoring, packing, formatting, extraction."""
