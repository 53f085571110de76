"""Operators for preparing training data: deduplication, filters, scans, scoring and mixing."""
