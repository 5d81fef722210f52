"""Spark-native telemetry quality, evaluation and drift analytics."""
