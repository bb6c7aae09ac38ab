"""Column functions and what they share."""
