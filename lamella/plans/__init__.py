"""Iterative fits, the method registry and experiment grids."""
