"""Operators: pure functions from DataFrames to a DataFrame (no collect, no session)."""
