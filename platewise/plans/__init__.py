"""Whole-report runs, and the binding of the sample tables to the model tables."""
