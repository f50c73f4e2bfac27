"""granary: a PySpark-native engine for text corpora and question banks."""

__version__ = "0.1.0"
