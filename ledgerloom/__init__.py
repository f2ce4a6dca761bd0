"""Spark-native analytics for panel transaction data."""
