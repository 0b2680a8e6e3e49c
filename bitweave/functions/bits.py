"""Monomials as fixed-width bit strings: Python integers on the driver, BIGINT words in tables.

Slot s is bit s % 64 of word s // 64. In the Majorana basis slot j is m_j; in the Pauli basis qubit q owns slots 2q
and 2q + 1, with X = {2q}, Y = {2q + 1}, Z = both. Builders below return SQL text over lists of word expressions.
"""

from __future__ import annotations

import numpy as np

M64 = (1 << 64) - 1
EVEN = 0x5555555555555555


def word_count(num_modes: int) -> int:
    return max(1, -(-2 * num_modes // 64))


def word_names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split(mask: int, words: int) -> list[int]:
    """The signed BIGINT words of a mask."""
    return [signed(mask >> 64 * i & M64) for i in range(words)]


def join(words) -> int:
    return sum((int(w) & M64) << 64 * i for i, w in enumerate(words))


def mask_of(slots) -> int:
    """Symmetric difference of the slots: a repeated slot cancels."""
    out = 0
    for s in slots:
        out ^= 1 << s
    return out


def slots_of(mask: int) -> tuple[int, ...]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return tuple(out)


def literal(x: int) -> str:
    """A BIGINT literal, also for the smallest value."""
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"({x}L)" if x < 0 else f"{x}L"


def popcount(words: list[str]) -> str:
    return "(" + " + ".join(f"bit_count({w})" for w in words) + ")" if words else "0"


def masked(words: list[str], mask: int) -> list[str]:
    """words & mask, without the words where the mask is 0."""
    return [f"({w} & {literal(m)})" for w, m in zip(words, split(mask, len(words))) if m]


def xored(words: list[str], mask: int) -> list[str]:
    return [f"({w} ^ {literal(m)})" if m else w for w, m in zip(words, split(mask, len(words)))]


def upper(words: list[str]) -> list[str]:
    """Each odd slot moved onto its even slot."""
    return [f"(shiftrightunsigned({w}, 1) & {EVEN}L)" for w in words]


def lower(words: list[str]) -> list[str]:
    return [f"({w} & {EVEN}L)" for w in words]


def paired(words: list[str]) -> str:
    """Whether every pair of slots 2q, 2q + 1 is both set or both clear."""
    return "(" + " AND ".join(f"(({w} ^ shiftrightunsigned({w}, 1)) & {EVEN}L) = 0L" for w in words) + ")"


def support(words: list[str]) -> str:
    return popcount([f"(({w} | shiftrightunsigned({w}, 1)) & {EVEN}L)" for w in words])


def least(words: list[str], others: list[str]) -> list[str]:
    """The smaller of two monomials by their signed words, first word first."""
    if len(words) == 1:
        return [f"least({words[0]}, {others[0]})"]
    smaller = "(" + " OR ".join("(" + " AND ".join([f"{a} = {b}" for a, b in zip(words[:i], others[:i])] + [f"{words[i]} < {others[i]}"]) + ")" for i in range(len(words))) + ")"
    return [f"if({smaller}, {a}, {b})" for a, b in zip(words, others)]


def changed_basis(words: list[str], rows: list[int]) -> list[str]:
    """XOR of the rows whose slot is set: the monomial's support in another basis."""
    out = []
    for i in range(len(words)):
        terms = [f"((shiftrightunsigned({words[s // 64]}, {s % 64}) & 1L) * {literal(split(r, len(words))[i])})" for s, r in enumerate(rows) if split(r, len(words))[i]]
        out.append("(" + " ^ ".join(terms) + ")" if terms else "0L")
    return out


# --- the same on numpy arrays of shape (.., words), uint64 ----------------------------------------------------


def np_words(mask: int, words: int) -> np.ndarray:
    return np.array([mask >> 64 * i & M64 for i in range(words)], np.uint64)


def np_popcount(m: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(m)
    out = counts[..., 0].astype(np.int64)
    for i in range(1, m.shape[-1]):  # few words: faster than a reduction over the last axis
        out += counts[..., i]
    return out


def np_paired(m: np.ndarray) -> np.ndarray:
    odd = (m ^ (m >> np.uint64(1))) & np.uint64(EVEN)
    out = odd[..., 0]
    for i in range(1, m.shape[-1]):
        out = out | odd[..., i]
    return out == 0


def np_support(m: np.ndarray) -> np.ndarray:
    return np_popcount((m | (m >> np.uint64(1))) & np.uint64(EVEN))


def np_changed_basis(m: np.ndarray, rows: list[int]) -> np.ndarray:
    out = np.zeros_like(m)
    for s, row in enumerate(rows):
        bit = (m[..., s // 64] >> np.uint64(s % 64)) & np.uint64(1)
        out ^= np.where(bit[..., None].astype(bool), np_words(row, m.shape[-1]), np.uint64(0))
    return out
