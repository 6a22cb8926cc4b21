"""A PySpark-native engine for music-acoustics analytics."""

__version__ = "0.1.0"
