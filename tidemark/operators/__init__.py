"""Operators: DataFrames of facts in, DataFrames of insights out."""
