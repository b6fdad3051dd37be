"""Spark-native analytics over large sets of time series, catalogues and results."""
