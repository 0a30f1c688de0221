"""siltstone: a Spark-native corpus retrieval and training-data engine."""

__version__ = "0.1.0"
