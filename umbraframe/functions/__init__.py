"""Scalar functions and the fixed values that they share."""
