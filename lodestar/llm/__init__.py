"""Operators for preparing training data from very large text corpora."""
