"""Column expressions and driver-side tail functions."""
