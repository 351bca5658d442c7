"""lexstrata: a Spark-native engine for versioned, hierarchical text corpora."""

__version__ = "0.1.0"
