"""Spark analytics for retail sales, procurement documents and permit applications.

Every operator is a function from DataFrames and parameters (column names, an
explicit as-of date) to a DataFrame.  Nothing here collects data to the driver.
"""
