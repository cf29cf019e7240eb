"""A Spark-native engine for document corpora and retrieval."""
