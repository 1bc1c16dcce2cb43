"""Spark-native curation, encoding and evaluation of natural-language / code corpora."""
