"""Column helpers for the places where the dialect differs from Spark's built-ins."""
