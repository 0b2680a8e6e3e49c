"""One rotation as a single-pass plan: project, one pair aggregate, inline. One shuffle, one read of the input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.algebra import Algebra
from .truncation import Truncation


def merge(terms: DataFrame, words: int) -> DataFrame:
    """Like terms merged: SUM(c) by monomial."""
    names = B.word_names(words)
    return terms.groupBy(*names).agg(F.sum("c").alias("c"))


def rotate(terms: DataFrame, algebra: Algebra, g: int, angle: float, cut: Truncation, schrodinger: bool = False, occupied: int = 0) -> DataFrame:
    """Rotate the table (w0.., c) by exp(i * angle * g).

    An anticommuting pair (k, p = k ^ g) becomes (cos a - sin phi b, cos b + sin phi a), with cos and sin of 2 * angle;
    an absent end counts as 0 and is inserted. In the Schroedinger picture the sine's sign flips and an absent paired
    end counts as its state phase. An empty g changes nothing. Pairs meet in a hash aggregate keyed by the smaller end.
    """
    if not g:
        return terms
    names = B.word_names(algebra.words)
    cos, sin = math.cos(2 * angle), math.sin(2 * angle)
    turn = -sin if schrodinger else sin
    partner = B.xored(names, g)
    key = B.least(names, partner)
    anti, eligible = algebra.anticommutes(names, g), cut.eligible(names)
    rows = terms.selectExpr(*names, "c", f"{anti} AS ac", f"{eligible} AS el")
    phase = algebra.phase(names, g)
    rows = rows.selectExpr(
        *[f"if(ac, {k}, {n}) AS k{i}" for i, (k, n) in enumerate(zip(key, names))],
        "ac",
        "(" + " AND ".join(f"{n} = {k}" for n, k in zip(names, key)) + ") AS first",
        "c",
        "el",
        f"if(ac, {phase}, 0) AS ph",
        f"(ac AND el AND {cut.feeds(partner, 'c', sin)}) AS fed",
    )
    keys = [f"k{i}" for i in range(algebra.words)]
    pairs = rows.groupBy(*keys, "ac").agg(
        *_exprs(
            {
                "c0": "max(if(first OR NOT ac, c, NULL))",
                "c1": "max(if(ac AND NOT first, c, NULL))",
                "ph": "max(if(first, ph, -ph))",
                "rot": "bool_or(fed)",
                "el0": "bool_or(first AND el)",
                "el1": "bool_or(NOT first AND el)",
            }
        )
    )
    if schrodinger:
        d0, d1 = (f"coalesce({algebra.state_phase(w, occupied)}, 0D)" for w in (keys, B.xored(keys, g)))
    else:
        d0 = d1 = "0D"
    # an absent end is never longer than its sources allow: its own cosine applies unless it is present and not eligible
    k0, k1 = (f"if({c} IS NULL OR {e}, {cos!r}D, 1D)" for c, e in (("c0", "el0"), ("c1", "el1")))
    v0, v1 = f"coalesce(c0, {d0})", f"coalesce(c1, {d1})"
    new0 = f"if(rot, {k0} * {v0} - ({turn!r}D * ph) * {v1}, {k0} * c0)"
    new1 = f"if(rot, {k1} * {v1} + ({turn!r}D * ph) * {v0}, {k1} * c1)"

    def struct(ws, c):
        return "struct(" + ", ".join([f"{w} AS {n}" for w, n in zip(ws, names)] + [f"{c} AS c"]) + ")"

    ends = f"filter(array({struct(keys, new0)}, {struct(B.xored(keys, g), new1)}), z -> z.c IS NOT NULL)"
    return pairs.selectExpr(f"inline(if(ac, {ends}, array({struct(keys, 'c0')})))")


def _exprs(columns: dict[str, str]):
    return [F.expr(e).alias(n) for n, e in columns.items()]
