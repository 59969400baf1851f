"""Scalar functions as Column expressions, and Arrow kernels where expressions can't say it."""
