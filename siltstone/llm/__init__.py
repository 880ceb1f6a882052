"""Operators for preparing training data: filters, near-duplicates, search, scoring, mixing."""
