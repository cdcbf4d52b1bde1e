"""Column functions: all built-in expressions, no Python in the data path."""
