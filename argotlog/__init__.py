"""Command lines as a text corpus, on Spark DataFrames."""

__version__ = "0.1.0"
