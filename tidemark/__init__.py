"""tidemark: a PySpark-native analytics engine for event-style tables."""
