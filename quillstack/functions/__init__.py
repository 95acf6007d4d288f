"""Column expressions: text, greedy folds and vectors."""
