"""Operators for large text and vector corpora (training-data preparation)."""
