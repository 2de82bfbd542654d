"""Scalar functions on value columns."""
