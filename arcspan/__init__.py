"""A Spark-native analytics engine for security telemetry."""
