"""Operators on sets of words and their graphs."""
