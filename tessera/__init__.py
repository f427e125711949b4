"""Spark-native depth-aware signal analytics."""
