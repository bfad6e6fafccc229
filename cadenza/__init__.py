"""Cadenza: ordered-signal analytics as PySpark DataFrames."""
