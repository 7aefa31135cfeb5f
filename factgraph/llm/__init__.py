"""Operators for preparing training text: encoding, filtering, deduplication, search, mixing and storage."""
