"""Authoring on tables: what terms.py and conversions.py do with Python objects, for operators of any size.

Majorana terms are (idx ARRAY<INT>, re, im); ladder terms (modes ARRAY<INT>, raising ARRAY<BOOLEAN>, c); stored rows
(w0.., c). All are DataFrame functions; like terms meet in one hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..store import local_frame
from .conversions import BLOCKS


def inversions(items: str) -> str:
    """SQL text: how many pairs of an array are out of order; equal items are not."""
    return f"aggregate(flatten(transform({items}, (x, i) -> transform(slice({items}, i + 2, size({items})), y -> int(x > y)))), 0, (a, b) -> a + b)"


def normal_ordered(terms: DataFrame) -> DataFrame:
    """Products of Majoranas in any order, with repeats, as sums of ascending products: sorting takes the sign of the
    permutation, equal neighbours cancel, like terms add up."""
    sign = f"if({inversions('idx')} % 2 = 0, 1, -1)"
    left = "filter(array_distinct(array_sort(idx)), x -> size(filter(idx, y -> y = x)) % 2 = 1)"
    rows = terms.selectExpr(f"{left} AS idx", f"{sign} * re AS re", f"{sign} * im AS im")
    return rows.groupBy("idx").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def encoded(terms: DataFrame, num_modes: int, basis: str = "majorana", atol: float = 1e-10) -> DataFrame:
    """Stored rows (w0.., c) of ascending products (idx, re, im): in the Majorana basis a coefficient is divided by
    i ** (n choose 2). A residue beyond atol, or a slot out of range, raises."""
    words = B.word_count(num_modes)
    turn = "0" if basis == "pauli" else "CAST((size(idx) * (size(idx) - 1) div 2) % 4 AS INT)"
    c, rest = f"element_at(array(re, im, -re, -im), {turn} + 1)", f"element_at(array(im, re, im, re), {turn} + 1)"
    checked = f"if(abs({rest}) > {atol!r}D, raise_error('a coefficient is not Hermitian'), if(exists(idx, i -> i < 0 OR i >= {2 * num_modes}), raise_error('index out of range'), {c}))"
    cols = [f"aggregate(filter(idx, i -> i div 64 = {w}), 0L, (a, i) -> a ^ shiftleft(1L, CAST(i % 64 AS INT))) AS {n}" for w, n in enumerate(B.word_names(words))]
    return terms.selectExpr(*cols, f"CAST({checked} AS DOUBLE) AS c").groupBy(*B.word_names(words)).agg(F.sum("c").alias("c"))


def decoded(rows: DataFrame, num_modes: int, basis: str = "majorana") -> DataFrame:
    """(idx, re, im) of stored rows."""
    from ..sources.tables import slots_of_words

    turn = "0" if basis == "pauli" else "CAST((size(idx) * (size(idx) - 1) div 2) % 4 AS INT)"
    return slots_of_words(rows, num_modes).selectExpr("idx", f"element_at(array(c, 0D, -c, 0D), {turn} + 1) AS re", f"element_at(array(0D, c, 0D, -c), {turn} + 1) AS im")


def canonical_ladders(terms: DataFrame) -> DataFrame:
    """Raising operators first, each kind by ascending mode, with the sign of the reordering; like terms add up."""
    keyed = terms.selectExpr("zip_with(modes, raising, (m, up) -> if(up, 0L, 1L << 32) + m) AS keys", "c")
    rows = keyed.selectExpr("array_sort(keys) AS keys", f"if({inversions('keys')} % 2 = 0, c, -c) AS c").groupBy("keys").agg(F.sum("c").alias("c"))
    return rows.selectExpr("transform(keys, k -> CAST(k & 4294967295L AS INT)) AS modes", "transform(keys, k -> k < (1L << 32)) AS raising", "c")


def majoranas_of_ladders(terms: DataFrame) -> DataFrame:
    """Ladder terms as ascending Majorana products (idx, re, im): a ladder operator on mode q is half of m_2q plus i
    times m_2q+1, with the sign of i turned if it raises. A term of L operators becomes 2**L products."""
    each = terms.withColumn("bits", F.expr("explode(sequence(0L, shiftleft(1L, size(modes)) - 1))"))
    places = "sequence(0, size(modes) - 1)"
    idx = f"if(size(modes) = 0, array(), transform({places}, k -> 2 * modes[k] + CAST(shiftright(bits, k) & 1 AS INT)))"
    turns = f"if(size(modes) = 0, 0, aggregate({places}, 0, (a, k) -> a + if(shiftright(bits, k) & 1 = 0, 0, if(raising[k], 3, 1))))"
    half = "c / shiftleft(1L, size(modes))"
    rows = each.selectExpr(f"CAST({idx} AS ARRAY<INT>) AS idx", f"{turns} % 4 AS turn", f"{half} AS v")
    return normal_ordered(rows.selectExpr("idx", "element_at(array(v, 0D, -v, 0D), turn + 1) AS re", "element_at(array(0D, v, 0D, -v), turn + 1) AS im"))


def integral_ladders(one: DataFrame, two: DataFrame, n: int, h0: float = 0.0, atol: float = 1e-12) -> DataFrame:
    """Canonical ladder terms of molecular integrals as tables: one (spin, p, q, value), two (block, p, q, r, t, value) in
    chemist's notation, blocks numbered as in conversions.BLOCKS. The rule is integrals_to_fermion's."""
    spins = [f"element_at(array({', '.join(str(b[i]) for b in BLOCKS)}), block + 1) * {n}" for i in (0, 1)]
    single = one.selectExpr(f"array(p + spin * {n}, q + spin * {n}) AS modes", "array(true, false) AS raising", "CAST(value AS DOUBLE) AS c")
    pair = two.selectExpr(f"{spins[0]} AS a", f"{spins[1]} AS b", "p", "q", "r", "t", "CAST(value AS DOUBLE) AS value").where("NOT (p + a = r + b OR q + a = t + b)")
    pair = pair.selectExpr("array(p + a, r + b, t + b, q + a) AS modes", "array(true, true, false, false) AS raising", "if(a = b, 0.5D, 1D) * value AS c")
    ladders = [df.selectExpr("CAST(modes AS ARRAY<INT>) AS modes", "raising", "c") for df in (single, pair)]
    scalar = local_frame(one.sparkSession, [([], [], float(h0))], "modes array<int>, raising array<boolean>, c double")
    return canonical_ladders(scalar.unionByName(ladders[0]).unionByName(ladders[1])).where(F.abs("c") > atol)


def jordan_wigner_rows(rows: DataFrame, num_qubits: int) -> DataFrame:
    """Stored Pauli rows as stored Majorana rows.

    A qubit with an odd number of X and Y above it loses or gains the string's Z, which turns both of its slots; each
    turned letter and each whole pair contributes a quarter turn to the phase.
    """
    names = B.word_names(B.word_count(num_qubits))
    even = f"{B.EVEN}L"
    out = rows.selectExpr(*names, "c", *[f"({n} ^ shiftrightunsigned({n}, 1)) & {even} AS odd{i}" for i, n in enumerate(names)])
    above = ["if((0 " + "".join(f"+ bit_count(odd{j}) " for j in range(i + 1, len(names))) + f") % 2 = 1, {even}, 0L)" for i in range(len(names))]
    out = out.selectExpr(*names, "c", *[f"shiftrightunsigned(odd{i}, 2) AS t{i}" for i in range(len(names))], *[f"{a} AS up{i}" for i, a in enumerate(above)])
    for step in (2, 4, 8, 16, 32):
        out = out.selectExpr(*names, "c", *[f"t{i} ^ shiftrightunsigned(t{i}, {step}) AS t{i}" for i in range(len(names))], *[f"up{i}" for i in range(len(names))])
    out = out.selectExpr(*names, "c", *[f"t{i} ^ up{i} AS t{i}" for i in range(len(names))])
    out = out.selectExpr(*names, "c", *[f"{n} ^ (t{i} | shiftleft(t{i}, 1)) AS s{i}" for i, n in enumerate(names)])
    turns = []
    for i, n in enumerate(names):
        x, z, a, b = f"({n} & {even})", f"(shiftrightunsigned({n}, 1) & {even})", f"(s{i} & {even})", f"(shiftrightunsigned(s{i}, 1) & {even})"
        turns.append(f"bit_count({a} & {b}) + bit_count({b} & ~{a} & {x} & ~{z}) - bit_count({a} & ~{b} & {z} & ~{x})")
    size = " + ".join(f"bit_count(s{i})" for i in range(len(names)))
    out = out.selectExpr("c", *[f"s{i} AS {n}" for i, n in enumerate(names)], f"{' + '.join(turns)} AS turn", f"{size} AS size")
    return out.selectExpr(*names, "if(pmod(turn + size * (size - 1) div 2, 4) = 0, c, -c) AS c")


def pauli_labels(rows: DataFrame, num_qubits: int, reverse: bool = False) -> DataFrame:
    """Rows with label, the letters of each Pauli term, qubit 0 first, or last as external packages write it."""
    names = B.word_names(B.word_count(num_qubits))
    letters = [f"substr('IXYZ', CAST(shiftrightunsigned({names[q // 32]}, {2 * (q % 32)}) & 3L AS INT) + 1, 1)" for q in range(num_qubits)]
    return rows.withColumn("label", F.expr(f"concat({', '.join(letters[::-1] if reverse else letters)})"))


def pauli_words(rows: DataFrame, num_qubits: int, reverse: bool = False) -> DataFrame:
    """The words of each label of letters I, X, Y, Z; any other letter or length raises."""
    names = B.word_names(B.word_count(num_qubits))
    label = "reverse(label)" if reverse else "label"
    cols = []
    for w, n in enumerate(names):
        places = f"sequence({32 * w}, {min(32 * w + 32, num_qubits) - 1})"
        cols.append(f"aggregate({places}, 0L, (a, q) -> a | shiftleft(CAST(locate(substr({label}, q + 1, 1), 'XYZ') AS LONG), 2 * (q - {32 * w}))) AS {n}")
    checked = rows.where(F.when(F.col("label").rlike(f"^[IXYZ]{{{num_qubits}}}$"), True).otherwise(F.raise_error(F.lit("not a Pauli string of this width"))))
    return checked.selectExpr("*", *cols)


def rotations_of(gates: DataFrame) -> DataFrame:
    """Named rotations (name, qubits ARRAY<INT>, value) as gates (idx ARRAY<INT>, gcoef, angle): r<letters>(t) is
    exp(-i t/2 <letters>), so the generator is -1/2 times the letters; barriers are skipped, other names raise."""
    from ..sources.files import ROTATIONS

    known = F.col("name").isin(*ROTATIONS)
    rows = gates.where("name <> 'barrier'").where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unsupported gate "), F.col("name")))))
    slots = "transform(qubits, (q, i) -> CASE substr(name, i + 2, 1) WHEN 'x' THEN array(2 * q) WHEN 'y' THEN array(2 * q + 1) ELSE array(2 * q, 2 * q + 1) END)"
    return rows.selectExpr(f"array_sort(flatten({slots})) AS idx", "-0.5D AS gcoef", "CAST(value AS DOUBLE) AS angle")


def is_close(left: DataFrame, right: DataFrame, words: int, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row (terms, close, equal): stored rows compared term by term over the union of their terms, absent ones
    being 0. The tolerance is relative to the right side."""
    names = B.word_names(words)
    both = left.select(*names, "c").join(right.select(*names, F.col("c").alias("d")), names, "full_outer").fillna(0.0, ["c", "d"])
    close = F.abs(F.col("c") - F.col("d")) <= atol + rtol * F.abs("d")
    return both.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum(close.cast("long")), F.lit(0)).alias("close"), F.coalesce(F.bool_and(close), F.lit(True)).alias("equal"))


def products_commute(generators: DataFrame, words: int, basis: str) -> DataFrame:
    """(gate, commute): whether the stored terms of each gate commute with one another. A gate's terms are gathered, the
    terms of all gates are not."""
    names = B.word_names(words)
    pairs = generators.groupBy("gate").agg(F.collect_list(F.struct(*names)).alias("g"))
    counts = []
    for i, n in enumerate(names):
        other = f"((shiftleft(y.{n} & {B.EVEN}L, 1)) | (shiftrightunsigned(y.{n}, 1) & {B.EVEN}L))" if basis == "pauli" else f"y.{n}"
        counts.append(f"bit_count(x.{n} & {other})")
    odd = " + ".join(counts)
    if basis == "majorana":
        size = lambda v: "(" + " + ".join(f"bit_count({v}.{n})" for n in names) + ")"
        odd = f"{size('x')} * {size('y')} + {odd}"
    return pairs.selectExpr("gate", f"forall(g, x -> forall(g, y -> x = y OR ({odd}) % 2 = 0)) AS commute")
