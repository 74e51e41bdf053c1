"""Column-level expressions shared by the operators."""
