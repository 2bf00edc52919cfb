"""Declarative data integration, data quality and metadata on Spark DataFrames."""

__version__ = "0.1.0"
