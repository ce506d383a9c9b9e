"""Column functions on DNA words."""
