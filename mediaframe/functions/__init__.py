"""Column helpers and the ordered-scan building blocks."""
