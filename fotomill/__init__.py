"""Spark-native analytics for large photo and video libraries."""
