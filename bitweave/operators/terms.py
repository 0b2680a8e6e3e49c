"""Terms and operators as a user writes them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import bits as B
from ..functions.algebra import Algebra


def system_size(size, name: str) -> int:
    if isinstance(size, bool) or not isinstance(size, (int, np.integer)):
        raise TypeError(f"{name} must be an integer, not {type(size).__name__}")
    if size < 0:
        raise ValueError(f"{name} must not be negative: {size}")
    return int(size)


def sort_sign(items) -> tuple[tuple, int]:
    """The items in ascending order, and the parity of the permutation that sorts them (equal items do not cross)."""
    items, sign = list(items), 1
    for i in range(len(items)):
        sign *= (-1) ** sum(items[i] > x for x in items[i + 1 :])
    return tuple(sorted(items)), sign


def cancel_pairs(indices: tuple[int, ...]) -> tuple[int, ...]:
    """Equal neighbours of a sorted product of Majoranas cancel: m * m = 1."""
    out: list[int] = []
    for i in indices:
        if out and out[-1] == i:
            out.pop()
        else:
            out.append(i)
    return tuple(out)


def _close(a: dict, b: dict, rtol: float, atol: float) -> bool:
    return all(np.isclose(a.get(k, 0), b.get(k, 0), rtol=rtol, atol=atol) for k in a.keys() | b.keys())


@dataclass(frozen=True, init=False, order=True)
class Majorana:
    """A product of distinct Majoranas in ascending order."""

    indices: tuple[int, ...]

    def __init__(self, *indices: int):
        indices = tuple(int(i) for i in indices)
        if any(i < 0 for i in indices):
            raise ValueError("Majorana indices must not be negative")
        if list(indices) != sorted(set(indices)):
            raise ValueError("Majorana indices must be distinct and ascending; see from_unsorted")
        object.__setattr__(self, "indices", indices)

    @classmethod
    def from_unsorted(cls, *indices: int) -> tuple[Majorana, float]:
        ordered, sign = sort_sign(indices)
        return cls(*ordered), float(sign)

    @property
    def mask(self) -> int:
        return B.mask_of(self.indices)

    def __len__(self) -> int:
        return len(self.indices)

    def __iter__(self):
        return iter(self.indices)


class MajoranaOperator:
    """A sum of Majorana products: {ascending indices: complex}. Unsorted keys take their sign, repeats add up."""

    def __init__(self, terms, num_modes: int):
        self.num_modes = system_size(num_modes, "num_modes")
        self.terms: dict[tuple[int, ...], complex] = {}
        for key, value in terms.items():
            key = tuple(key.indices if isinstance(key, Majorana) else key)
            if any(i < 0 or i >= 2 * self.num_modes for i in key):
                raise ValueError(f"{key} has an index outside 0..{2 * self.num_modes - 1}")
            ordered, sign = sort_sign(int(i) for i in key)
            ordered = cancel_pairs(ordered)
            self.terms[ordered] = self.terms.get(ordered, 0) + sign * complex(value)

    @classmethod
    def from_lists(cls, majoranas, coefficients, num_modes: int) -> MajoranaOperator:
        """Parallel lists; like terms add up."""
        out = cls({}, num_modes)
        for key, value in zip(majoranas, coefficients, strict=True):
            for k, v in cls({tuple(key): value}, num_modes).terms.items():
                out.terms[k] = out.terms.get(k, 0) + v
        return out

    def get_majorana_operator(self) -> MajoranaOperator:
        return self

    def masks(self) -> dict[int, complex]:
        return {B.mask_of(k): v for k, v in self.terms.items()}

    def isclose(self, other, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        if not isinstance(other, MajoranaOperator):
            raise TypeError(f"cannot compare with {type(other).__name__}")
        return self.num_modes == other.num_modes and _close(self.terms, other.terms, rtol, atol)

    def all_pairwise_commute(self) -> bool:
        return all_commute(list(self.masks()), "majorana")

    def __len__(self) -> int:
        return len(self.terms)

    def __eq__(self, other) -> bool:
        return isinstance(other, MajoranaOperator) and (self.num_modes, self.terms) == (other.num_modes, other.terms)

    __hash__ = None

    def __repr__(self) -> str:
        return f"MajoranaOperator({self.terms}, num_modes={self.num_modes})"


def all_commute(masks: list[int], basis: str) -> bool:
    words = max(1, -(-max((m.bit_length() for m in masks), default=1) // 64))
    algebra = Algebra(basis, words)
    table = np.stack([B.np_words(m, words) for m in masks]) if masks else np.zeros((0, words), np.uint64)
    return not any(algebra.np_anticommutes(table, g).any() for g in masks)


_SLOTS = {"X": (0,), "Y": (1,), "Z": (0, 1)}


@dataclass(frozen=True, init=False, order=True)
class Pauli:
    """Letters on qubits, identities dropped, by ascending qubit."""

    string: str
    qubits: tuple[int, ...]

    def __init__(self, string: str, qubits=None):
        qubits = tuple(range(len(string))) if qubits is None else tuple(int(q) for q in qubits)
        if len(string) != len(qubits):
            raise ValueError("one letter per qubit is needed")
        if set(string) - set("IXYZ"):
            raise ValueError(f"{string!r} has letters other than I, X, Y, Z")
        if len(set(qubits)) != len(qubits) or any(q < 0 for q in qubits):
            raise ValueError("qubits must be distinct and not negative")
        kept = sorted((q, s) for q, s in zip(qubits, string) if s != "I")
        object.__setattr__(self, "string", "".join(s for _, s in kept))
        object.__setattr__(self, "qubits", tuple(q for q, _ in kept))

    @property
    def mask(self) -> int:
        return B.mask_of(2 * q + s for q, letter in zip(self.qubits, self.string) for s in _SLOTS[letter])

    @classmethod
    def from_mask(cls, mask: int) -> Pauli:
        slots = set(B.slots_of(mask))
        qubits = sorted({s // 2 for s in slots})
        letter = {(True, False): "X", (False, True): "Y", (True, True): "Z"}
        return cls("".join(letter[2 * q in slots, 2 * q + 1 in slots] for q in qubits), qubits)


class PauliOperator:
    """A real sum of Pauli terms: {Pauli or full string: float}."""

    def __init__(self, terms, num_qubits: int):
        self.num_qubits = system_size(num_qubits, "num_qubits")
        self.terms: dict[Pauli, float] = {}
        for key, value in terms.items():
            self._add(key, value)

    @classmethod
    def from_lists(cls, paulis, coefficients, num_qubits: int) -> PauliOperator:
        out = cls({}, num_qubits)
        for key, value in zip(paulis, coefficients, strict=True):
            out._add(key, value)
        return out

    def _add(self, key, value) -> None:
        pauli = Pauli(key) if isinstance(key, str) else key
        if pauli.qubits and pauli.qubits[-1] >= self.num_qubits:
            raise ValueError(f"{pauli} acts beyond {self.num_qubits} qubits")
        value = np.real_if_close(value)
        if np.iscomplexobj(value):
            raise ValueError(f"coefficient of {pauli} must be real")
        self.terms[pauli] = self.terms.get(pauli, 0.0) + float(value)

    def masks(self) -> dict[int, float]:
        return {p.mask: c for p, c in self.terms.items()}

    def get_local_operator(self) -> MajoranaOperator:
        """Slot lists of the Pauli basis, as index tuples."""
        out = MajoranaOperator({}, self.num_qubits)
        out.terms = {B.slots_of(m): complex(c) for m, c in self.masks().items()}
        return out

    def get_majorana_operator(self) -> MajoranaOperator:
        from .conversions import jordan_wigner

        out = MajoranaOperator({}, self.num_qubits)
        for pauli, c in self.terms.items():
            indices, phase = jordan_wigner(pauli)
            out.terms[indices] = out.terms.get(indices, 0) + c * phase
        return out

    def isclose(self, other, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        if not isinstance(other, PauliOperator):
            raise TypeError(f"cannot compare with {type(other).__name__}")
        return self.num_qubits == other.num_qubits and _close(self.terms, other.terms, rtol, atol)

    def all_pairwise_commute(self) -> bool:
        return all_commute(list(self.masks()), "pauli")

    def __len__(self) -> int:
        return len(self.terms)

    def __eq__(self, other) -> bool:
        return isinstance(other, PauliOperator) and (self.num_qubits, self.terms) == (other.num_qubits, other.terms)

    __hash__ = None

    def __repr__(self) -> str:
        return f"PauliOperator({self.terms}, num_qubits={self.num_qubits})"


@dataclass(frozen=True, init=False)
class FermiString:
    """An ordered product of ladder operators (mode, '+' or '-')."""

    expression: tuple[tuple[int, str], ...]

    def __init__(self, expression):
        expression = tuple((int(m), str(s)) for m, s in expression)
        if any(m < 0 for m, _ in expression):
            raise ValueError("modes must not be negative")
        if any(s not in "+-" or len(s) != 1 for _, s in expression):
            raise ValueError("a ladder operator is '+' or '-'")
        object.__setattr__(self, "expression", expression)

    def canonical(self) -> tuple[tuple[tuple[int, str], ...], int]:
        """Raising operators first, each kind by ascending mode, and the sign of the reordering."""
        ordered, sign = sort_sign((s == "-", m) for m, s in self.expression)
        return tuple((m, "-" if low else "+") for low, m in ordered), sign

    def majoranas(self) -> dict[tuple[int, ...], complex]:
        """2**L products: raising m - i m', lowering m + i m', each halved."""
        out: dict[tuple[int, ...], complex] = {(): 1.0 + 0j}
        for mode, kind in self.expression:
            step: dict[tuple[int, ...], complex] = {}
            for key, value in out.items():
                for extra, factor in ((2 * mode, 0.5), (2 * mode + 1, -0.5j if kind == "+" else 0.5j)):
                    ordered, sign = sort_sign((*key, extra))
                    ordered = cancel_pairs(ordered)
                    step[ordered] = step.get(ordered, 0) + value * factor * sign
            out = step
        return out


class FermiOperator:
    """A sum of ladder products: parallel lists of terms and coefficients."""

    def __init__(self, terms, coefficients, num_modes: int):
        self.num_modes = system_size(num_modes, "num_modes")
        self.terms = [t if isinstance(t, FermiString) else FermiString(t) for t in terms]
        self.coefficients = list(coefficients)
        if len(self.terms) != len(self.coefficients):
            raise ValueError("one coefficient per term is needed")
        for t in self.terms:
            if any(m >= self.num_modes for m, _ in t.expression):
                raise ValueError(f"{t} acts beyond {self.num_modes} modes")

    @classmethod
    def from_dict(cls, terms, num_modes: int) -> FermiOperator:
        return cls(list(terms), list(terms.values()), num_modes)

    def get_majorana_operator(self) -> MajoranaOperator:
        out = MajoranaOperator({}, self.num_modes)
        for term, c in zip(self.terms, self.coefficients):
            for key, value in term.majoranas().items():
                out.terms[key] = out.terms.get(key, 0) + c * value
        return out

    def isclose(self, other, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        if not isinstance(other, FermiOperator):
            raise TypeError(f"cannot compare with {type(other).__name__}")
        if self.num_modes != other.num_modes:
            return False
        sides = []
        for op in (self, other):  # of terms that are canonically alike the last one counts
            side = {}
            for t, c in zip(op.terms, op.coefficients):
                key, sign = t.canonical()
                side[key] = c * sign
            sides.append(side)
        return _close(*sides, rtol, atol)

    def __len__(self) -> int:
        return len(self.terms)

    def __eq__(self, other) -> bool:
        return isinstance(other, FermiOperator) and (self.num_modes, self.terms, self.coefficients) == (other.num_modes, other.terms, other.coefficients)

    __hash__ = None

    def __repr__(self) -> str:
        return f"FermiOperator({len(self)} terms, num_modes={self.num_modes})"
