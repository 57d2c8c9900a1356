"""Palimpsest: a PySpark-native engine for conversational-memory data."""
