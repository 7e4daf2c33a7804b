"""Operators for training-data pipelines: one module each, queries in ``queries.py``."""
