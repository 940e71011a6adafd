"""Column functions on text and names."""
