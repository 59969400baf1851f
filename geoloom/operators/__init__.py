"""Relational and geometric operators over DataFrames."""
