"""Collect, clean, cluster and track text records with Spark DataFrames."""

__version__ = "0.1.0"
