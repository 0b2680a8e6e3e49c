"""Parametric problems: spin lattices, the Hubbard chain, and random circuits."""

from __future__ import annotations

import numpy as np

from .operators.circuit import Circuit, ExpGate
from .operators.terms import FermiOperator, MajoranaOperator, Pauli, PauliOperator


def grid_bonds(nx: int, ny: int) -> list[tuple[int, int]]:
    """Nearest neighbours of a row-major grid."""
    sites = [(x, y) for y in range(ny) for x in range(nx)]
    return [(y * nx + x, (y + dy) * nx + x + dx) for x, y in sites for dx, dy in ((1, 0), (0, 1)) if x + dx < nx and y + dy < ny]


def heavy_hex_bonds() -> list[tuple[int, int]]:
    """127 qubits: seven rows of 15 (the outer ones of 14), joined by four bridge qubits between neighbouring rows."""
    bonds, start, before = [], 0, None
    for row in range(7):
        first = 1 if row == 6 else 0
        columns = range(first, 14 if row == 0 else 15)
        qubit = {c: start + c - first for c in columns}
        bonds += [(qubit[c], qubit[c + 1]) for c in columns if c + 1 in qubit]
        if before is not None:
            bonds += [(bridge, qubit[c]) for c, bridge in before.items()]
        start += len(columns)
        before = {c: start + i for i, c in enumerate(range(2 * (row % 2), 15, 4)) if c in qubit}
        if row < 6:
            bonds += [(qubit[c], bridge) for c, bridge in before.items()]
            start += len(before)
    return bonds


def rotation(letters: str, qubits, n: int) -> ExpGate:
    """exp(-i t/2 P) driven by t."""
    return ExpGate(PauliOperator({Pauli(letters, qubits): -0.5}, n))


def tilted_ising(nx: int, ny: int, steps: int, *, dt: float = 0.05, j: float = 1.5, hx: float = 1.0, hz: float = 1.0) -> tuple[PauliOperator, Circuit]:
    """Trotter steps of a 2-D tilted-field Ising model, and ZZ on its central bond: exp(-i dt/2 P) of each term, bonds
    with j, then Z fields, then X fields."""
    n, gates, angles = nx * ny, [], []
    for letters, where, angle in (("ZZ", grid_bonds(nx, ny), j * dt), ("Z", [(q,) for q in range(n)], hz * dt), ("X", [(q,) for q in range(n)], hx * dt)):
        gates += [rotation(letters, q, n) for q in where]
        angles += [angle] * len(where)
    middle = (ny // 2) * nx + max(nx // 2 - 1, 0)
    return PauliOperator({Pauli("ZZ", (middle, middle + 1)): 1.0}, n), Circuit(gates * steps, n, angles * steps, ())


def kicked_ising(steps: int, *, theta: float = np.pi / 4, j: float = np.pi / 4, qubit: int = 62) -> tuple[PauliOperator, Circuit]:
    """Kicks exp(-i theta/2 X) and couplings exp(i j ZZ) on 127 heavy-hex qubits, and Z on one of them."""
    n, bonds = 127, heavy_hex_bonds()
    gates = [rotation("X", (q,), n) for q in range(n)] + [rotation("ZZ", b, n) for b in bonds]
    angles = [theta] * n + [-2 * j] * len(bonds)
    return PauliOperator({Pauli("Z", (qubit,)): 1.0}, n), Circuit(gates * steps, n, angles * steps, ())


def hubbard_chain(sites: int, steps: int, *, dt: float = 0.2, hopping: float = 1.0, interaction: float = -2.0, potential: float = 0.0, bricks: bool = False, site: int = 0) -> tuple[FermiOperator, Circuit]:
    """First-order Trotter steps of the 1-D Hubbard model from the Neel state; modes 2s (up) and 2s + 1 (down).
    The observable is the density of spin up at a site. Bonds go along the chain, both spins at each; as bricks the even
    bonds come before the odd ones, all of spin up before those of spin down."""
    n, terms = 2 * sites, []
    along = [(s, spin) for s in range(sites - 1) for spin in (0, 1)]
    if bricks:
        along.sort(key=lambda bond: (bond[1], bond[0] % 2, bond[0]))
    for s, spin in along:
        a, b = 2 * s + spin, 2 * s + 2 + spin
        terms.append({((a, "+"), (b, "-")): -hopping, ((b, "+"), (a, "-")): -hopping})
    terms += [{((2 * s, "+"), (2 * s, "-"), (2 * s + 1, "+"), (2 * s + 1, "-")): interaction} for s in range(sites)]
    terms += [{((m, "+"), (m, "-")): -potential} for m in range(n) if potential]
    gates = [ExpGate(FermiOperator.from_dict(t, n)) for t in terms]
    neel = [2 * s + s % 2 for s in range(sites)]
    return FermiOperator.from_dict({((2 * site, "+"), (2 * site, "-")): 1.0}, n), Circuit(gates * steps, n, [dt] * (len(gates) * steps), neel)


def random_majorana(modes: int = 128, terms: int = 10_000, generators: int = 100, length: int = 4, seed: int | None = None) -> tuple[MajoranaOperator, Circuit]:
    """A random observable, and one random generator per parameter; angles are small."""
    rng = np.random.default_rng(seed)

    def draw(n):
        return [tuple(sorted(rng.choice(2 * modes, length, replace=False).tolist())) for _ in range(n)]

    phase = 1j ** (length * (length - 1) // 2 % 4)
    observable = MajoranaOperator.from_lists(draw(terms), phase * rng.standard_normal(terms), modes)
    circuit = Circuit.from_dense_arrays(draw(generators), rng.standard_normal(generators).tolist(), list(range(generators)), modes, (0.1 * rng.standard_normal(generators)).tolist(), ())
    return observable, circuit
