"""Column functions: normalisation and scoring formulas as Catalyst expressions."""
