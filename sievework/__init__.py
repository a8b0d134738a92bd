"""Data-quality, curation and corpus-preparation engine built on Spark DataFrames."""

__version__ = "0.1.0"
