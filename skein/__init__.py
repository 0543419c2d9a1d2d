"""Skein: a PySpark-native event-fusion and training-data engine."""
