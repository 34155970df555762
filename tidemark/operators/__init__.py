"""Operators: functions from DataFrames to DataFrames, lazy unless the name says otherwise."""
