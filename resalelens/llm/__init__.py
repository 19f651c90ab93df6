"""Operators of a training-data pipeline over text, vector and page tables."""
