"""Spark-native tagged binary documents and training-data operators."""
