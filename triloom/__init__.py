"""Spark-native sample/feature index and three-valued query engine."""
