"""Column functions and row-wise operators."""
