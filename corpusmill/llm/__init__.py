"""Operators for building training data at scale: scans, filters, duplicate search, classifiers and packing."""
