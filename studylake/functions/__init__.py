"""Column expressions: values in, values out, nothing but built-in Spark functions."""
