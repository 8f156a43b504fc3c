"""Domain plans built from the operators."""
