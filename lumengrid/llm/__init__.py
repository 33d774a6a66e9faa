"""Corpus operators for training-data pipelines (deduplication, scoring, scanning, mixing)."""
