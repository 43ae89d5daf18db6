"""Column functions: no shuffles, no Python at run time."""
