"""Quillon: a PySpark-native hybrid retrieval and analytics engine."""
