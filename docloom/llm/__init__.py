"""Operators that prepare training text: scans, packing, deduplication, classifiers, archives, search."""
