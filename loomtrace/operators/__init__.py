"""Operators on the state tables: DataFrames in, DataFrames out."""
