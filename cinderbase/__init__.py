"""PySpark-native engine for decaying text memories and the data pipelines around them."""

__all__ = ["session"]
