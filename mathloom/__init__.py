"""Spark-native engine for curating reasoning data."""
