"""Column expressions: values, keys, conflict strategies, scalar and clock functions."""
