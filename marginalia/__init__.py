"""Marginalia: a PySpark-native retrieval and text-processing engine."""
