"""Operators: pure functions from frames and parameters to frames."""
