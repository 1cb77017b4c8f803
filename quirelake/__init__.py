"""Spark-native analytics for scanned-document pages."""
