"""pathloom: a PySpark-native engine for corpora of token paths, texts and vectors."""

__version__ = "0.1.0"
