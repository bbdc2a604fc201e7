"""Spark-native building blocks for map data and training-data pipelines."""
