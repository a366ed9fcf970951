"""Column functions on bases and words."""
