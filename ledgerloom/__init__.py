"""A Spark-native engine for document collections."""
