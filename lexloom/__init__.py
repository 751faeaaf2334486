"""lexloom: a Spark-native engine for legal text corpora and retrieval."""

__version__ = "0.1.0"
