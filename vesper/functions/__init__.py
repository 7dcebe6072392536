"""Column expressions: scalars, dates, nested arrays, and the fixed values they depend on."""
