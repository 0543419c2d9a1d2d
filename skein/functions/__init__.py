"""Spark-first building blocks of the event-fusion engine."""
