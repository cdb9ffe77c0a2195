"""Column expressions and small learners."""
