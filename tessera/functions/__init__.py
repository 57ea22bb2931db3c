"""Column builders: text rules, exact numerics, fixed lexicons."""
