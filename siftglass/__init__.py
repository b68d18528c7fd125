"""Spark-native inspection and cleaning of hidden content."""
