"""Strandlake: a PySpark-native engine for adaptive sequencing analytics."""
