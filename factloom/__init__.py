"""Spark-native analytics for due-diligence document collections."""
