"""Spark-native processing of magnetotelluric recordings."""

__version__ = "0.1.0"
