"""Column builders; all of them are Catalyst expressions."""
