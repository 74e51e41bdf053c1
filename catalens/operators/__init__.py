"""Operators: functions that take DataFrames and column names and return DataFrames."""
