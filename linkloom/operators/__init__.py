"""Relational steps of record linkage on DataFrames."""
