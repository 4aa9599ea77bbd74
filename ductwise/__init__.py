"""Spark-native analytics for equipment telemetry, diagnostic episodes and training text."""
