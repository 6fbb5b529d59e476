"""Column expressions shared by the sources, operators and plans."""
