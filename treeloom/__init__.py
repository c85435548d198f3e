"""Spark-native analytics over code corpora, their history and usage ledgers."""
