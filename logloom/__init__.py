"""A PySpark-native engine that turns conversation logs into a searchable store."""
