"""Column functions: money, text, tolerance, confidence."""
