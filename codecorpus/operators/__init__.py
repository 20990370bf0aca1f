"""Operators: functions from DataFrames to DataFrames, keyed by ``repo``."""
