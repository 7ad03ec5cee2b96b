"""Operators over tables of texts and spans."""
