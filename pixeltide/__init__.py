"""Spark-native analytics over image time series kept as ordinary tables."""
