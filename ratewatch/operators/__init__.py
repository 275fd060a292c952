"""Operators on rate panels and article tables: DataFrames in, DataFrames out."""
