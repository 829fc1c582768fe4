"""A PySpark-native analytics engine for server diagnostic telemetry."""
