"""Column and scalar functions."""
