"""Operators for preparing training data: filtering, deduplication, tokenising, packing, archives."""
