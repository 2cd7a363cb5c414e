"""Operators for training-data pipelines; see `catalog` for the registered queries."""
