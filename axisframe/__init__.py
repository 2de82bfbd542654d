"""N-dimensional array analytics on Spark: tensors are tables, array operators are DataFrame functions."""
