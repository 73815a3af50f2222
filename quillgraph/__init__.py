"""Spark-native document analytics and knowledge-graph engine."""
