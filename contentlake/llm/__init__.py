"""Operators for preparing training text: scoring, deduplication, tokenising, packing, search.

Nothing else in the library imports this subpackage.
"""
