"""Truncation rules of a rotation, as SQL text and over numpy arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from numbers import Integral, Real

import numpy as np

from ..errors import ToleranceOrderError
from ..functions import bits as B


@dataclass(frozen=True)
class Predicate:
    """A rule of one's own for partners: sql maps the partner's word expressions to a Boolean SQL text, array maps its
    words (.., words) of uint64 to Booleans. Both must say the same."""

    sql: Callable[[list[str]], str]
    array: Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Truncation:
    """Which rotations are carried out.

    A source m may feed its partner n = m ^ g if n is paired or its length (or support) is at most cutoff, unless
    |sin 2theta| * |c(m)| <= lower; a partner beyond the cutoff is still fed if that product is >= upper. A pair is
    rotated if either of its present ends may feed the other. Monomials longer than longest_source feed nothing and are
    not scaled. basis_rows measures n in another basis. With a predicate, n must satisfy that, too.
    """

    cutoff: int
    kind: str = "length"
    lower: float | None = None
    upper: float | None = None
    longest_source: int | None = None
    basis_rows: tuple[int, ...] | None = None
    predicate: Predicate | None = None

    def __post_init__(self):
        if isinstance(self.cutoff, bool) or not isinstance(self.cutoff, (Integral, np.integer)):
            raise TypeError(f"cutoff must be an integer, not {self.cutoff!r}")
        if self.cutoff < 0:
            raise ValueError(f"cutoff must not be negative: {self.cutoff}")
        for name, value in (("lower_atol", self.lower), ("upper_atol", self.upper)):
            if value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, Real):
                raise TypeError(f"{name} must be a number or None, not {value!r}")
            if not value >= 0:
                raise ValueError(f"{name} must not be negative: {value}")
        if self.predicate is not None and not isinstance(self.predicate, Predicate):
            raise TypeError(f"predicate must be a Predicate or None, not {self.predicate!r}")
        if self.kind not in ("length", "support"):
            raise ValueError("cutoff_type must be 'length' or 'support'")
        if self.lower is not None and self.upper is not None and self.upper < self.lower:
            raise ToleranceOrderError(f"upper_atol ({self.upper}) must be greater than or equal to lower_atol ({self.lower})")

    def keeps(self, n: list[str]) -> str:
        """Whether the structure of the partner's words n allows it."""
        extra = f" AND ({self.predicate.sql(n)})" if self.predicate else ""
        if self.basis_rows is not None:
            n = B.changed_basis(n, list(self.basis_rows))
        size = B.popcount(n) if self.kind == "length" else B.support(n)
        return f"(({B.paired(n)} OR {size} <= {int(self.cutoff)}){extra})"

    def feeds(self, n: list[str], coefficient: str, sine: float) -> str:
        size = f"(abs({coefficient}) * {abs(sine)!r}D)"
        out = self.keeps(n)
        if self.upper is not None:
            out = f"({out} OR {size} >= {self.upper!r}D)"
        if self.lower is not None:
            out = f"({out} AND {size} > {self.lower!r}D)"
        return out

    def eligible(self, m: list[str]) -> str:
        return "TRUE" if self.longest_source is None else f"({B.popcount(m)} <= {int(self.longest_source)})"

    def np_keeps(self, n: np.ndarray) -> np.ndarray:
        extra = self.predicate.array(n) if self.predicate else True
        if self.basis_rows is not None:
            n = B.np_changed_basis(n, list(self.basis_rows))
        size = B.np_popcount(n) if self.kind == "length" else B.np_support(n)
        return (B.np_paired(n) | (size <= self.cutoff)) & extra

    def np_feeds(self, keeps: np.ndarray, coefficient: np.ndarray | None, sine: float) -> np.ndarray:
        """keeps: np_keeps of the partner. Without coefficients only the structure counts."""
        if coefficient is None:
            return keeps
        size = np.abs(coefficient) * abs(sine)
        if self.upper is not None:
            keeps = keeps | (size >= self.upper)
        return keeps & (size > self.lower) if self.lower is not None else keeps

    def np_eligible(self, m: np.ndarray) -> np.ndarray:
        return np.ones(m.shape[:-1], bool) if self.longest_source is None else B.np_popcount(m) <= self.longest_source
