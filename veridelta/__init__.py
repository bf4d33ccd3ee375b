"""Spark-first engine for temporal fact graphs, claim data sets and their evaluation."""

__version__ = "0.1.0"
