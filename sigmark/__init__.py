"""Spark-native analytics of measured time curves and their conditions."""
