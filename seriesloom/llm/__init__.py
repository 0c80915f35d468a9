"""Corpus operators for training-data pipelines over a ``documents`` or ``pages`` table."""
