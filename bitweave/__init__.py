"""A PySpark engine that propagates weighted sums of bit-string monomials through circuits of rotations."""

from .models import heavy_hex_bonds, hubbard_chain, kicked_ising, random_majorana, tilted_ising
from .operators import Circuit, ExpGate, FermiOperator, FermiString, Majorana, MajoranaOperator, Pauli, PauliOperator, integrals_to_fermion, jordan_wigner_basis_change
from .propagator import MAX_NUM_MODES, MajoranaPropagator, PauliPropagator

__all__ = [
    "MAX_NUM_MODES",
    "Circuit",
    "ExpGate",
    "FermiOperator",
    "FermiString",
    "Majorana",
    "MajoranaOperator",
    "MajoranaPropagator",
    "Pauli",
    "PauliOperator",
    "PauliPropagator",
    "heavy_hex_bonds",
    "hubbard_chain",
    "integrals_to_fermion",
    "jordan_wigner_basis_change",
    "kicked_ising",
    "random_majorana",
    "tilted_ising",
]
