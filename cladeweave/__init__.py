"""Spark-native quartet inference."""
