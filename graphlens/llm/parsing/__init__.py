"""Recursive-descent parsers that only judge syntax, with panic-mode recovery."""
