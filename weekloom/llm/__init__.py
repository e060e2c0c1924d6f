"""Operators for training-data pipelines: dedup, filters, classifiers, extraction, counting and mixing."""
