"""Column builders: every function takes and returns Columns, so Catalyst sees plain expressions."""
