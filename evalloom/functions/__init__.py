"""Column functions and the small distributions library."""
