"""wordloom: a PySpark-native analytics engine for multilingual text corpora and terminology."""

__version__ = "0.1.0"
