"""Operators over tables: DataFrames in, DataFrames out."""
