"""Column functions: text, paths, vectors, time."""
