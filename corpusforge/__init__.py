"""corpusforge: a Spark-native engine for building, searching and measuring text corpora."""

__version__ = "0.1.0"
