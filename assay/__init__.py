"""assay: a PySpark-native engine for judged-score data."""

__version__ = "0.1.0"
