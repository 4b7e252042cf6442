"""Spark-native analytics over large collections of prose."""

__version__ = "0.1.0"
