"""Column functions: text, numbers, intervals and vectors."""
