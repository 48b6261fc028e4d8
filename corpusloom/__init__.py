"""corpusloom: a PySpark-native engine for change-tracked, searchable web corpora."""

__version__ = "0.1.0"
