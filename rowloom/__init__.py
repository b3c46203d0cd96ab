"""Spark-native analytics over gridded and ordered data."""
