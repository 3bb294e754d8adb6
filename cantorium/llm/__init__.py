"""Operators that prepare training data: packing, mixing, scans, classifiers, near-duplicates, search and token output."""
