"""Spark-native fact analytics."""
