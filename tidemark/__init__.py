"""PySpark-native event-to-mart engine."""
