"""Scalar functions over monomials."""
