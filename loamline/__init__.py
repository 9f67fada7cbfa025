"""Loamline: Spark-native analytics over archives of collaboration data."""
