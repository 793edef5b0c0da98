"""auralake: a PySpark-native library for the data work around an audio language model."""

__all__ = ["config"]
