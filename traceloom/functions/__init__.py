"""Column functions: text scalars, confidence metrics over arrays, answer equivalence."""
