"""Operators: functions from DataFrames to a DataFrame (or to columns of one)."""
