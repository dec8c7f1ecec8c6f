"""Column functions: numbers, vectors, names."""
