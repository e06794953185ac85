"""Column builders: pure expressions, no shuffle, no Python workers."""
