"""Scalar functions with IEEE-754 semantics."""
