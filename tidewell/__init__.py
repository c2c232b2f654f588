"""Spark-native operators for conversational memory data and training-text pipelines."""

__version__ = "0.1.0"
