"""Operators on signals, as DataFrame plans."""
