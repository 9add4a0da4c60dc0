"""Column expressions: calendar, accuracy metrics, text."""
