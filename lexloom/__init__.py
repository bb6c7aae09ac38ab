"""Spark-native subword tokenization and text encoding."""

__version__ = "0.1.0"
