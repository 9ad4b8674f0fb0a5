"""Column expressions and row-wise clean-up used by the builders and the marts."""
