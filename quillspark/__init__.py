"""A Spark-native engine for document transforms, data quality and corpus work."""
