"""Column functions and vectorised scanners."""
