"""Spark-native analytics over multi-sensor measurement streams."""
