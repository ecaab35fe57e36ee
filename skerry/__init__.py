"""A Spark-native engine for building and querying a document knowledge base."""
