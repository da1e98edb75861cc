"""glyphlake: a Spark-native engine that treats PNG files as relational tables."""

__version__ = "0.1.0"
