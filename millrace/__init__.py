"""millrace: a Spark-native engine for scoped document retrieval and analytics."""

__version__ = "0.1.0"
