"""Column functions: scalars, vectors as arrays, and texts."""
