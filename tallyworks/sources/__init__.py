"""Readers for files, schemas of the logical tables, and views over driver tables."""
