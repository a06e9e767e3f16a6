"""Operators for training-data pipelines over tables of documents; nothing else in the library imports this subpackage."""
