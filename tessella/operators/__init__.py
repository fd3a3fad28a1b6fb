"""Spark-native feature engineering and training-data operators."""
