"""Spark-native table operators for risk features and transaction analytics."""
