"""Column functions and small dense solvers."""
