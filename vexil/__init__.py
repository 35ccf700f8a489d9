"""A PySpark-native vector search and analytics engine."""
