"""Spark-native genomics record engine and training-data operators."""
