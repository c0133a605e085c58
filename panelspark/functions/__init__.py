"""Column and DataFrame functions that operators are made of."""
