"""Spark-native retrieval, gap scoring, evaluation and training-data operators."""
