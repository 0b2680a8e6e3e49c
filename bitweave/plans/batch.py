"""Batches of rotations with one shuffle: cosets of the generators' span are rotated where they meet.

Every rotation by g in a span S takes a monomial m within m ^ S, and truncation looks at m and m ^ g alone. Rows are
dealt by their coset's representative, so partners are always in one bucket, and a numpy kernel rotates a bucket gate
after gate: it sorts the rows that anticommute by the hash of their pair's lower end and finds partners side by side.
The lower end of a pair lacks the generator's lowest slot. k rotations cost one shuffle instead of k; a table that fits
one task needs none, whatever the span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.algebra import Algebra
from .truncation import Truncation


@dataclass(frozen=True)
class Rotation:
    """exp(i * angle * g), the layer-th rotation of its graph (or circuit)."""

    g: int
    angle: float
    layer: int = 0


@dataclass
class Span:
    """A reduced echelon basis over GF(2): each pivot slot is set in its own vector alone."""

    vectors: list[int]
    pivots: list[int]

    @classmethod
    def of(cls, generators) -> Span:
        out = cls([], [])
        for g in generators:
            out.add(g)
        return out

    def reduce(self, m: int) -> int:
        for v, p in zip(self.vectors, self.pivots):
            if m >> p & 1:
                m ^= v
        return m

    def add(self, g: int) -> bool:
        g = self.reduce(g)
        if not g:
            return False
        p = (g & -g).bit_length() - 1
        self.vectors = [v ^ g if v >> p & 1 else v for v in self.vectors] + [g]
        self.pivots.append(p)
        return True

    def representative(self, w: list[str]) -> list[str]:
        """SQL text of the words of the coset's representative: all pivot slots clear."""
        words = len(w)
        out = list(w)
        for v, p in zip(self.vectors, self.pivots):
            bit = f"(shiftrightunsigned({w[p // 64]}, {p % 64}) & 1L)"
            out = [f"({o} ^ ({bit} * {B.literal(x)}))" if x else o for o, x in zip(out, B.split(v, words))]
        return out


def batches(rotations: list[Rotation], max_rank: int | None = 6, max_rotations: int = 256) -> list[list[Rotation]]:
    """Consecutive rotations whose generators span at most max_rank dimensions (None: any number)."""
    out: list[list[Rotation]] = []
    span = Span([], [])
    for r in rotations:
        if not r.g:
            continue
        grown = max_rank is not None and span.add(r.g)
        if not out or (grown and len(span.vectors) > max_rank) or len(out[-1]) >= max_rotations:
            out.append([])
            span = Span.of([r.g])
        out[-1].append(r)
    return out


# --- rows of one bucket ---------------------------------------------------------------------------------------


class Collision(RuntimeError):
    """Two monomials of one bucket have the same hash; another salt tells them apart."""


@lru_cache(maxsize=16)
def _hash_tables(words: int, salt: int) -> np.ndarray:
    """Random 64-bit values for each byte of each word, additive over XOR."""
    bits = np.random.default_rng(salt).integers(0, 1 << 64, (words, 8, 8), np.uint64)
    out = np.zeros((words, 8, 256), np.uint64)
    for i in range(8):
        has = (np.arange(256) >> i & 1).astype(bool)
        out[:, :, has] ^= bits[:, :, i : i + 1]
    return out


def linear_hash(m: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash with h(a ^ b) = h(a) ^ h(b); of one word the word itself."""
    if m.shape[1] == 1:
        return m[:, 0].copy()
    tables, out = _hash_tables(m.shape[1], salt), np.zeros(len(m), np.uint64)
    for w in range(m.shape[1]):
        for i in range(8):
            out ^= tables[w, i][(m[:, w] >> np.uint64(8 * i)) & np.uint64(255)]
    return out


class _Rows:
    """A bucket's rows as columns with room to grow: words, hash, coefficient and the layer that inserted each."""

    def __init__(self, m: np.ndarray, c: np.ndarray, born: np.ndarray, salt: int):
        self.n, self.salt, self.words = len(m), salt, m.shape[1]
        self._columns = [*(np.ascontiguousarray(m[:, w]) for w in range(self.words)), linear_hash(m, salt), np.array(c, float), np.array(born, np.int32)]

    def append(self, m: np.ndarray, hashes: np.ndarray, c: np.ndarray, born: int) -> None:
        n = self.n + len(m)
        if n > len(self._columns[0]):
            self._columns = [np.concatenate((x[: self.n], np.empty(max(n, 2 * self.n, 64) - self.n, x.dtype))) for x in self._columns]
        for x, new in zip(self._columns, [*(m[:, w] for w in range(self.words)), hashes, c, born]):
            x[self.n : n] = new
        self.n = n

    @property
    def hash(self) -> np.ndarray:
        return self._columns[self.words][: self.n]

    @property
    def c(self) -> np.ndarray:
        return self._columns[self.words + 1][: self.n]

    @property
    def born(self) -> np.ndarray:
        return self._columns[self.words + 2][: self.n]

    def monomials(self, at=slice(None)) -> np.ndarray:
        return np.stack([x[: self.n][at] for x in self._columns[: self.words]], axis=1)

    def anticommuting(self, algebra: Algebra, g: int) -> np.ndarray:
        """Places of the rows that anticommute with g: a parity over the words that g touches."""
        odd = algebra.basis == "majorana" and g.bit_count() % 2
        masks = B.np_words(algebra.partner_mask(g), self.words)
        total = np.zeros(self.n, np.uint8)
        for x, mask in zip(self._columns[: self.words], masks):
            if odd:
                total += np.bitwise_count(x[: self.n])
            if mask:
                total += np.bitwise_count(x[: self.n] & mask)
        return np.flatnonzero(total & np.uint8(1))

    def bit(self, slot: int, at: np.ndarray) -> np.ndarray:
        return (self._columns[slot // 64][at] >> np.uint64(slot % 64) & np.uint64(1)).astype(bool)


def _lowest(g: int) -> int:
    return (g & -g).bit_length() - 1


def _salted(run):
    """run(salt) with the first salt under which no two monomials collide."""
    for salt in range(8):
        try:
            return run(salt)
        except Collision:
            continue
    raise Collision("monomials collide under every salt")


def _schema(algebra: Algebra) -> tuple[str, pa.Schema]:
    names = B.word_names(algebra.words)
    text = "kind int, " + ", ".join(f"{n} long" for n in names) + ", c double, layer int, n long"
    arrow = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in names), ("c", pa.float64()), ("layer", pa.int32()), ("n", pa.int64())])
    return text, arrow


#: Kinds of result row: a term, a rotated pair, a layer's count of rows that only scale, how many rotations were done.
ROW, EDGE, COSINE, DONE = 0, 1, 2, 3


def _table(schema: pa.Schema, kind: int, m: np.ndarray, c=None, layer=None, n=None) -> pa.Table:
    size = len(m)
    cols = [np.full(size, kind, np.int32), *(m[:, i].view(np.int64) if m.dtype == np.uint64 else m[:, i] for i in range(m.shape[1]))]
    cols += [np.zeros(size) if c is None else c, np.zeros(size, np.int32) if layer is None else layer, np.zeros(size, np.int64) if n is None else n]
    return pa.table([pa.array(np.ascontiguousarray(x), f.type) for x, f in zip(cols, schema)], schema=schema)


def _one(schema: pa.Schema, kind: int, words: int, c=0.0, layer=0, n=0) -> pa.Table:
    return _table(schema, kind, np.zeros((1, words), np.uint64), np.array([c]), np.array([layer], np.int32), np.array([n]))


def _words(rows: pa.Table, words: int) -> np.ndarray:
    return np.stack([rows[n].to_numpy().view(np.uint64) for n in B.word_names(words)], axis=1)


def evolve(rows: DataFrame, algebra: Algebra, batch: list[Rotation], cut: Truncation, *, schrodinger: bool = False, occupied: int = 0, informed: bool = True, record: bool = False, buckets: int | None = None, limit: int | None = None) -> DataFrame:
    """Rotate (w0.., c, layer) rows by a batch. layer: the rotation that inserted the row, -1 for initial rows.

    informed: truncation sees coefficients. record: also give, as other kinds of row, each rotated pair (EDGE, by its
    lower end and layer) and the count of cosine-only rows per layer (COSINE, in n). buckets=1 runs in one task without a
    shuffle; with a limit it stops before a rotation (but the first) once there are more rows, and says how many
    rotations were done (DONE, in n).
    """
    text, schema = _schema(algebra)
    names = B.word_names(algebra.words)
    words = algebra.words

    def pair_up(t: _Rows, idx: np.ndarray, r: Rotation, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the rows at idx are lower ends and which their upper ends, where both are there."""
        hashed = linear_hash(B.np_words(r.g, words)[None, :], t.salt)[0]
        key = t.hash[idx] ^ np.where(high, hashed, np.uint64(0))
        order = np.argsort(key)
        ordered = key[order]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        x, y = order[same], order[same + 1]
        low, up = np.where(high[x], y, x), np.where(high[x], x, y)
        if (t.monomials(idx[low]) ^ B.np_words(r.g, words) != t.monomials(idx[up])).any():
            raise Collision
        return low, up

    def rotate(t: _Rows, r: Rotation, out: list) -> None:
        idx = t.anticommuting(algebra, r.g)
        cos, sin = math.cos(2 * r.angle), math.sin(2 * r.angle)
        turn = -sin if schrodinger else sin
        gw = B.np_words(r.g, words)
        high = t.bit(_lowest(r.g), idx)
        low, up = pair_up(t, idx, r, high)
        m, c = t.monomials(idx), t.c[idx]
        eligible = cut.np_eligible(m)
        rot = eligible & cut.np_feeds(cut.np_keeps(m ^ gw), c if informed else None, sin)
        rot[low] = rot[up] = rot[low] | rot[up]
        value = np.where(eligible, cos, 1.0) * c
        at = np.flatnonzero(rot)
        m, above = m[at], high[at]
        partner = m ^ gw
        lower = np.where(above[:, None], partner, m)
        step = algebra.np_phase(lower, r.g) * np.where(above, turn, -turn)
        other = np.empty(len(idx))
        other[at] = algebra.np_state_phase(partner, occupied) if schrodinger else 0.0
        other[low], other[up] = c[up], c[low]
        value[at] += step * other[at]
        t.c[idx] = value
        lone = np.ones(len(idx), bool)
        lone[low] = lone[up] = False
        new = lone[at]
        if record:
            first = new | ~above  # a pair of present rows once, by its lower end
            out.append(_one(schema, COSINE, words, layer=r.layer, n=int((eligible & ~rot).sum())))
            out.append(_table(schema, EDGE, lower[first], layer=np.full(int(first.sum()), r.layer, np.int32)))
        if new.any():
            hashed = linear_hash(gw[None, :], t.salt)[0]
            t.append(partner[new], t.hash[idx[at[new]]] ^ hashed, cos * other[at[new]] - step[new] * c[at[new]], r.layer)

    def kernel(table: pa.Table) -> pa.Table:
        def run(salt: int) -> pa.Table:
            t = _Rows(_words(table, words), table["c"].to_numpy(), table["layer"].to_numpy(), salt)
            out, done = [], 0
            for r in batch:
                if limit is not None and done and t.n > limit:
                    break
                rotate(t, r, out)
                done += 1
            if limit is not None:
                out.append(_one(schema, DONE, words, n=done))
            return pa.concat_tables([_table(schema, ROW, t.monomials(), t.c, t.born), *out])

        return _salted(run)

    rows = rows.select(*names, "c", "layer")
    if buckets == 1:
        dealt = rows.coalesce(1)
    else:
        # whole cosets in each task, by the hash of their representatives; nothing has to be sorted
        n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(n, *[F.expr(x) for x in Span.of(r.g for r in batch).representative(names)])
    result = dealt.mapInArrow(_in_one(kernel), text)
    return result if record or limit is not None else result.select(*names, "c", "layer")


def _in_one(kernel):
    """The kernel over all of a task's rows."""

    def function(found):
        held = list(found)
        if held:
            yield from kernel(pa.Table.from_batches(held)).to_batches()

    return function


def evenly(rows: DataFrame, algebra: Algebra, batch: list[Rotation], buckets: int) -> float:
    """How many times its share the fullest bucket would hold, were rows dealt for this batch."""
    names = B.word_names(algebra.words)
    counts = _bucketed(rows.select(*names), Span.of(r.g for r in batch), names, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return most * buckets / total if total else 0.0


def _bucketed(rows: DataFrame, span: Span, names: list[str], buckets: int | None) -> DataFrame:
    if buckets == 1:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("bucket", F.expr(f"pmod(xxhash64({', '.join(span.representative(names))}), {n}L)"))


def replay(rows: DataFrame, edges: DataFrame, algebra: Algebra, batch: list[Rotation], cut: Truncation, buckets: int | None = None) -> DataFrame:
    """Carry (w0.., c, layer) through recorded layers: every row that was there scales by its cosine where it
    anticommutes, and the recorded pairs add their sines."""
    return _replay(rows, edges, algebra, batch, cut, buckets, backward=False)


def replay_back(rows: DataFrame, edges: DataFrame, algebra: Algebra, batch: list[Rotation], cut: Truncation, buckets: int | None = None) -> DataFrame:
    """The transposed sweep: rows hold c (values before the batch) and back (sensitivities after it). Gives rows with
    back as c (sensitivities before it), and per layer the sum of back * d(values)/d(angle), as EDGE rows in c."""
    return _replay(rows, edges, algebra, batch, cut, buckets, backward=True)


def _replay(rows: DataFrame, edges: DataFrame, algebra: Algebra, batch: list[Rotation], cut: Truncation, buckets: int | None, backward: bool) -> DataFrame:
    text, schema = _schema(algebra)
    names = B.word_names(algebra.words)
    words = algebra.words
    some = edges.where(F.col("layer").isin([r.layer for r in batch])).select(*names, "layer").toDF(*names, "layer")  # columns of its own, should both come from one table
    value = ["c", "layer", *(["back"] if backward else [])]

    def kernel(table: pa.Table, found: pa.Table, salt: int) -> pa.Table:
        t = _Rows(_words(table, words), table["c"].to_numpy(), table["layer"].to_numpy(), salt)
        order = np.argsort(t.hash)
        ordered = t.hash[order]
        if (ordered[1:] == ordered[:-1]).any():
            raise Collision
        ends, of = (_words(found, words), found["layer"].to_numpy()) if len(found) else (np.zeros((0, words), np.uint64), np.zeros(0, np.int32))
        by = np.argsort(of, kind="stable")
        ends, of = ends[by], of[by]
        hashes = linear_hash(ends, salt)
        eligible = cut.np_eligible(t.monomials())
        c, born, steps = t.c, t.born, []
        for r in batch:
            cos, sin = math.cos(2 * r.angle), math.sin(2 * r.angle)
            idx = t.anticommuting(algebra, r.g)
            idx = idx[(born[idx] < r.layer) & eligible[idx] | (born[idx] == r.layer)]
            mine = slice(*np.searchsorted(of, [r.layer, r.layer + 1]))
            hashed = linear_hash(B.np_words(r.g, words)[None, :], salt)[0]
            low, up = (order[np.searchsorted(ordered, h)] for h in (hashes[mine], hashes[mine] ^ hashed))
            phase = algebra.np_phase(ends[mine], r.g)
            a, b = c[low], c[up]
            if backward:
                steps.append((r, cos, sin, idx, c[idx], low, up, phase, a, b))
            c[idx] *= cos
            c[low] -= sin * phase * b
            c[up] += sin * phase * a
        if not backward:
            return _table(schema, ROW, t.monomials(), c, born)
        back = np.array(table["back"].to_numpy())
        out = []
        for r, cos, sin, idx, before, low, up, phase, a, b in reversed(steps):
            x, y = back[low], back[up]
            slope = cos * (phase * (y * a - x * b)).sum() - sin * (back[idx] * before).sum()
            out.append(_one(schema, EDGE, words, 2.0 * slope, r.layer))
            back[idx] *= cos
            back[low] += sin * phase * y
            back[up] -= sin * phase * x
        return pa.concat_tables([_table(schema, ROW, t.monomials(), back, born), *out])

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return _table(schema, ROW, np.zeros((0, words), np.uint64))
        return _salted(lambda salt: kernel(table, found, salt))

    span = Span.of(r.g for r in batch) if buckets != 1 else Span([], [])
    left = _bucketed(rows.select(*names, *value), span, names, buckets).groupBy("bucket")
    right = _bucketed(some, span, names, buckets).groupBy("bucket")
    return left.cogroup(right).applyInArrow(run, text)
