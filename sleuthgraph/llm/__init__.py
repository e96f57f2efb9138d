"""Operators that prepare training data: filtering, deduplication, decontamination, extraction and packing."""
