"""Spark-native analytics over evidenced relationship graphs built from versioned text."""
