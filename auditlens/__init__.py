"""Labelled-text anomaly analytics on PySpark: DataFrames in, DataFrames out."""
