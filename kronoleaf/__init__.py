"""Spark-native analytics over personal-activity tables."""
