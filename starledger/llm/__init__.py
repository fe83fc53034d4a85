"""Operators for preparing text corpora, each a function on DataFrames."""
