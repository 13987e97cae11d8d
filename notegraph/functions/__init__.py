"""Column expressions: text, vectors, time and decay."""
