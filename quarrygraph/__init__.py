"""Spark-native analytics over bodies of SQL code."""
