"""Spark-native feature engineering: column operators, cleaning, selection, validation, search, and training-data operators."""
