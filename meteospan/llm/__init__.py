"""Operators for preparing training text: filtering, deduplication, tokenising and archives."""
