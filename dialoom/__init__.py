"""Spark-native engine for tutoring-dialogue corpora."""
