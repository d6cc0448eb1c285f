"""Analytical operators: DataFrames and parameters in, one DataFrame out."""
