"""Operators: DataFrame in, DataFrame out. See README.md for which file holds what."""
