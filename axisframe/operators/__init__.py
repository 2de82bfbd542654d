"""Tensor operators as joins, aggregations and windows."""
