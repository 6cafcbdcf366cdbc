"""Spark-native analytics over aligned character sequences and trees."""

__version__ = "0.1.0"
