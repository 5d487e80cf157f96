"""Column functions: scalar, string and array expressions that the operators are made of."""
