"""Operators for preparing training text: scans, classifiers, near-duplicates, packing, search."""
