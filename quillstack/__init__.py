"""Spark-native document retrieval and analytics engine."""
