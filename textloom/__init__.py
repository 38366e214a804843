"""A PySpark-native engine for text evidence."""
