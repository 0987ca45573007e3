"""Spark-native analytics over an evolving artifact graph and embedding collections."""
