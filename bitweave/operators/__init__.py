"""Authoring types: Majorana, Pauli and fermionic operators, circuits, and conversions between them."""

from .circuit import Circuit, ExpGate, expand_monomials, validate_parameter_mapping
from .conversions import integrals_to_fermion, jordan_wigner_basis_change
from .terms import FermiOperator, FermiString, Majorana, MajoranaOperator, Pauli, PauliOperator

__all__ = [
    "Circuit",
    "ExpGate",
    "FermiOperator",
    "FermiString",
    "Majorana",
    "MajoranaOperator",
    "Pauli",
    "PauliOperator",
    "expand_monomials",
    "integrals_to_fermion",
    "jordan_wigner_basis_change",
    "validate_parameter_mapping",
]
