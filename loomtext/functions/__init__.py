"""Column-valued text functions."""
