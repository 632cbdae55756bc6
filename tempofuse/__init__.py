"""Spark-native analytics for irregular multi-rate sensor series."""
