"""Column expressions shared by the operators and summaries."""
