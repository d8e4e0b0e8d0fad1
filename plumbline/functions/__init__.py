"""Column expressions and shared helpers the operators are composed of."""
