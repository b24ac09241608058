"""Cleaning steps: DataFrame in, DataFrame out."""
