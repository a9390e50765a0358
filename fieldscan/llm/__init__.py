"""Operators for preparing training data: dedup, scoring, packing, search and extraction over document tables."""
