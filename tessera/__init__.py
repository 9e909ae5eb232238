"""Spark-native analytics over ordered integer signals and image-like blocks."""
