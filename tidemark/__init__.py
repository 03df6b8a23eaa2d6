"""Spark-native analytics for dated evidence."""
