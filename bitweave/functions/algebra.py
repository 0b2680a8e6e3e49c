"""The two operator algebras: when monomials anticommute, and the sign of a rotation.

Every formula exists twice: as SQL text over word columns (code-generated by Spark) and over numpy arrays (for the
batch kernel). Tests hold both against dense matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import bits as B


def choose2(k: int) -> int:
    return k * (k - 1) // 2


def is_antihermitian(indices) -> bool:
    """Whether a product of len(indices) distinct Majoranas is antihermitian."""
    return choose2(len(indices)) % 2 == 1


def antihermitian_correction(indices) -> complex:
    """i if the product is Hermitian, else 1: the factor that makes it antihermitian."""
    return 1 if is_antihermitian(indices) else 1j


def parity_mask(mask: int, slots: int) -> int:
    """The slots that have an odd number of the mask's slots below them."""
    out, odd = 0, 0
    for s in range(slots):
        out |= odd << s
        odd ^= mask >> s & 1
    return out


def swapped(mask: int) -> int:
    """Slots 2q and 2q + 1 exchanged."""
    out = 0
    for s in B.slots_of(mask):
        out |= 1 << (s ^ 1)
    return out


@dataclass(frozen=True)
class Algebra:
    """'majorana' or 'pauli', for monomials of `words` words."""

    basis: str
    words: int

    def __post_init__(self):
        if self.basis not in ("majorana", "pauli"):
            raise ValueError(f"unknown basis {self.basis!r}")

    def partner_mask(self, g: int) -> int:
        """The slots whose parity decides anticommutation with g (with an odd Majorana g the length's counts, too)."""
        return swapped(g) if self.basis == "pauli" else g

    # SQL text; w is the list of word expressions

    def anticommutes(self, w: list[str], g: int) -> str:
        if self.basis == "pauli":
            return f"({B.popcount(B.masked(w, swapped(g)))} % 2 = 1)"
        odd = f"{B.popcount(w)} + " if g.bit_count() % 2 else ""
        return f"(({odd}{B.popcount(B.masked(w, g))}) % 2 = 1)"

    def interleave_sign(self, w: list[str], g: int) -> str:
        return f"(1 - 2 * ({B.popcount(B.masked(w, parity_mask(g, 64 * self.words)))} % 2))"

    def phase(self, w: list[str], g: int) -> str:
        """The sign with which a rotation by g takes w to w ^ g."""
        if self.basis == "pauli":
            x, z = B.lower(w), B.upper(w)
            n = B.xored(w, g)
            nx, nz = B.lower(n), B.upper(n)
            y = B.popcount([f"({b} & ~{a})" for a, b in zip(x, z)])
            ny = B.popcount([f"({b} & ~{a})" for a, b in zip(nx, nz)])
            gx = sum(1 << s for s in B.slots_of(g) if not s % 2)
            gz = sum(1 << s - 1 for s in B.slots_of(g) if s % 2)
            e = f"({(gz & ~gx).bit_count()} + {y} - {ny} + 2 * {B.popcount(B.masked(z, gx ^ gz))})"
            return f"if(pmod({e}, 4) = 1, -1, 1)"
        b = g.bit_count()
        a, common = B.popcount(w), B.popcount(B.masked(w, g))
        i = f"({a} + {b} - 2 * {common})"
        turn = f"pmod({a} * ({a} - 1) div 2 + {choose2(b) + 3} - {i} * ({i} - 1) div 2, 4)"
        return f"({self.interleave_sign(w, g)} * if({turn} = 0, 1, if({turn} = 2, -1, 0)))"

    def antihermitian(self, w: list[str]) -> str:
        """Whether the plain product of the monomial's Majoranas is antihermitian; Pauli products never are."""
        n = B.popcount(w)
        return "FALSE" if self.basis == "pauli" else f"(({n} * ({n} - 1) div 2) % 2 = 1)"

    def state_phase(self, w: list[str], occupied: int) -> str:
        """<b|M|b> of the product state; null where the monomial is not paired."""
        power = B.popcount(B.masked(w, occupied)) + ("" if self.basis == "pauli" else f" + {B.popcount(w)} div 2")
        return f"if({B.paired(w)}, if(({power}) % 2 = 0, 1.0D, -1.0D), NULL)"

    # numpy; m has shape (.., words)

    def np_anticommutes(self, m: np.ndarray, g: int) -> np.ndarray:
        if self.basis == "pauli":
            return B.np_popcount(m & B.np_words(swapped(g), self.words)) % 2 == 1
        odd = B.np_popcount(m) if g.bit_count() % 2 else 0
        return (odd + B.np_popcount(m & B.np_words(g, self.words))) % 2 == 1

    def np_phase(self, m: np.ndarray, g: int) -> np.ndarray:
        gw = B.np_words(g, self.words)
        even = np.uint64(B.EVEN)

        def parts(x):
            return x & even, (x >> np.uint64(1)) & even

        if self.basis == "pauli":
            (x, z), (nx, nz), (gx, gz) = parts(m), parts(m ^ gw), parts(gw)
            e = B.np_popcount(gz & ~gx) + B.np_popcount(z & ~x) - B.np_popcount(nz & ~nx) + 2 * B.np_popcount(z & (gx ^ gz))
            return np.where(e % 4 == 1, -1.0, 1.0)
        a, b, common = B.np_popcount(m), g.bit_count(), B.np_popcount(m & gw)
        i = a + b - 2 * common
        turn = (a * (a - 1) // 2 + choose2(b) + 3 - i * (i - 1) // 2) % 4
        sign = 1.0 - 2.0 * (B.np_popcount(m & B.np_words(parity_mask(g, 64 * self.words), self.words)) % 2)
        return sign * np.array([1.0, 0.0, -1.0, 0.0])[turn]

    def np_state_phase(self, m: np.ndarray, occupied: int) -> np.ndarray:
        """The state phase, 0 where the monomial is not paired."""
        power = B.np_popcount(m & B.np_words(occupied, self.words))
        if self.basis == "majorana":
            power = power + B.np_popcount(m) // 2
        return np.where(B.np_paired(m), 1.0 - 2.0 * (power % 2), 0.0)

    # coefficients at the edge

    def encode(self, mask: int, value: complex) -> float:
        """The real coefficient stored for an authored one; residue beyond 1e-10 raises ValueError."""
        value = complex(value) / (1j ** (choose2(mask.bit_count()) % 4) if self.basis == "majorana" else 1)
        if abs(value.imag) > 1e-10:
            raise ValueError(f"coefficient of {B.slots_of(mask)} is not Hermitian: {value}")
        return value.real

    def decode(self, mask: int, value: float) -> complex:
        return complex(value) * (1j ** (choose2(mask.bit_count()) % 4)) if self.basis == "majorana" else complex(value)


def occupied_mask(initial_state) -> int:
    """A product state's mask: slot 2i of each occupied index i."""
    return B.mask_of(2 * i for i in initial_state)
