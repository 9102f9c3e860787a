"""Scalar functions: Columns in, Columns out."""
