"""skein: a PySpark-native engine for web-content extraction and training-data work."""

__version__ = "0.1.0"
