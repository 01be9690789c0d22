"""Spark-native engine for time-aligned text: segments, cues, terms, feedback and job logs as DataFrames."""

__version__ = "0.1.0"
