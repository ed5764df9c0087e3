"""Whole computations from inputs to results."""
