"""A PySpark-native engine for document knowledge retrieval."""
