"""Column builders: pure expressions, no joins."""
