"""Operators of the document-to-graph engine: DataFrames in, DataFrames out."""
