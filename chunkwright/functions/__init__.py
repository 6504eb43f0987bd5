"""Column functions: text, vectors, scoring."""
