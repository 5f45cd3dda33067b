"""Operators for training-data pipelines: archives, near duplicates, quality, scans, mixing, output."""
