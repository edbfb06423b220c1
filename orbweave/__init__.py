"""Spark-native analytics over tables of located objects."""
