"""Spark-native analytics over gridded scientific fields."""
