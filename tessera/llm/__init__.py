"""Operators of a training-data pipeline: classifiers, deduplication, decontamination, search and mixing."""
