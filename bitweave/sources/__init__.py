"""Readers and writers of operators, gate lists, problems and molecular integrals."""

from .tables import read_circuit, read_operator, read_problem, write_circuit, write_operator, write_problem

__all__ = ["read_circuit", "read_operator", "read_problem", "write_circuit", "write_operator", "write_problem"]
