"""Column expressions: geometry, sun, identity and text. None is a Python UDF."""
