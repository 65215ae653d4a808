"""Spark-native pipelines for governed lakehouse data."""
