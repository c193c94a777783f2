"""Areal inference on Spark: labels, tokens, pixels, rank statistics and decisions."""

__version__ = "0.1.0"
