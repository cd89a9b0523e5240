"""PySpark-native engine for an ontology-backed document lake."""

__version__ = "0.1.0"
