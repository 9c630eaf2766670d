"""Spark-native web-corpus analytics and retrieval engine."""
