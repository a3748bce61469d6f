"""Operators over DataFrames; each one is lazy unless it writes."""
