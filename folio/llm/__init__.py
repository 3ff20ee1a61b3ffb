"""Operators for preparing training data: tokenizing, search, scoring, deduplication, packing and archives."""
