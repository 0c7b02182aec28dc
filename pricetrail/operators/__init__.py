"""Operators: functions from DataFrames to DataFrames. None of them has a hidden clock."""
