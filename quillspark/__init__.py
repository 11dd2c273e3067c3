"""Spark-native analytics over a catalog of opportunities, its users and its jobs."""
