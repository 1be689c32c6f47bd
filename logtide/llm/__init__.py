"""Operators for preparing training text: counting, filtering, deduplicating, mixing, packing."""
