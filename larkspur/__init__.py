"""Spark-native catalog, telemetry and statistics operators."""
