"""Corpus analytics, software lineage and training-data operators on Spark DataFrames."""

__version__ = "0.1.0"
