"""The engine's queries over the driver's tables, each through the library's own operators.

`narrow` operators fold lineitem's keys into 16 slots, so that pairs of present terms are frequent; `wide` ones have 48
slots in one word, or 40 in each of two, and as many terms as the table has orders.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.algebra import Algebra, occupied_mask
from ..models import tilted_ising
from ..operators import frames
from ..operators.circuit import Circuit, ExpGate
from ..operators.conversions import jordan_wigner_basis_change
from ..operators.terms import MajoranaOperator, Pauli, PauliOperator
from ..propagator import MajoranaPropagator, PauliPropagator
from ..sources import tables
from ..store import local_frame, shared_folder
from .batch import Rotation, batches, evolve
from .rotate import merge, rotate
from .truncation import Predicate, Truncation

SLOTS = 16  # 8 modes or qubits
MODES = SLOTS // 2
STATE = (0, 3, 5)
OCCUPIED = occupied_mask(STATE)
OPEN = Truncation(SLOTS)

#: Generators as slot masks: X1 Z3, Y2 Y6, Z0 X4, X7; and Majorana products of 2, 4 and 3 modes.
PAULI_GATES = [(B.mask_of((2, 6, 7)), 0.3), (B.mask_of((5, 13)), -0.45), (B.mask_of((0, 1, 8)), 0.7), (B.mask_of((14,)), 0.25)]
MAJORANA_GATES = [(B.mask_of((2, 5)), 0.3), (B.mask_of((0, 3, 7, 10)), -0.45), (B.mask_of((1, 6, 12)), 0.7), (B.mask_of((4, 15)), 0.25)]
#: On 24 qubits: X3 Z7, Y5 Y20, Z10 X17, X23; and in two words of 20 qubits each: X3 Z40, Y5 Y45, Z10 X50.
WIDE_GATES = [(B.mask_of((6, 14, 15)), 0.3), (B.mask_of((11, 41)), -0.45), (B.mask_of((20, 21, 34)), 0.7), (B.mask_of((46,)), 0.25)]
TWO_WORD_GATES = [(B.mask_of((6, 80, 81)), 0.3), (B.mask_of((11, 91)), -0.45), (B.mask_of((20, 21, 100)), 0.7)]
KEY = "(l_partkey * 2654435761L + l_suppkey * 40503L + l_linenumber)"
WIDE_KEY = "((l_partkey % 1048576) * 2654435761L + (l_suppkey % 1048576) * 40503L + (l_orderkey % 16777216) * 97L + l_linenumber)"
SECOND_KEY = "((l_orderkey % 16777216) * 48271L + (l_partkey % 1048576) * 69621L)"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _summed(rows: DataFrame, *words: str) -> DataFrame:
    return rows.groupBy(*words).agg((F.sum("q").cast("double") / 1000).alias("c"))


def operator(spark: SparkSession, sf_dir: str, slots: int = SLOTS) -> DataFrame:
    """A weighted sum of monomials over all of lineitem: the key is hashed to a bit string, quantities are summed."""
    rows = lineitem(spark, sf_dir).selectExpr(f"{KEY} & {(1 << slots) - 1}L AS w0", "CAST(l_quantity AS BIGINT) - 25 AS q")
    return _summed(rows, "w0")


def thinned(key: str, slots: int) -> str:
    """A key's bit string with a quarter of its bits set."""
    mixed = f"(({key} ^ shiftright({key}, 9)) & {(1 << slots) - 1}L)"
    return f"({mixed} & shiftright({mixed}, 5))"


def wide_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 slots; every fourth line gives a paired monomial, so that there is an expectation value."""
    even = int("01" * 24, 2)
    rows = lineitem(spark, sf_dir).selectExpr(f"{thinned(WIDE_KEY, 48)} AS t", "l_linenumber % 4 = 0 AS whole", "CAST(l_quantity AS BIGINT) - 25 AS q")
    return _summed(rows.selectExpr(f"if(whole, (t & {even}L) * 3, t) AS w0", "q"), "w0")


def two_word_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).selectExpr(f"{thinned(WIDE_KEY, 40)} AS w0", f"{thinned(SECOND_KEY, 40)} AS w1", "CAST(l_quantity AS BIGINT) - 25 AS q")
    return _summed(rows, "w0", "w1")


# --- results --------------------------------------------------------------------------------------------------


def _public(rows: DataFrame) -> DataFrame:
    """m and c, rounded so that sums in another order compare equal."""
    return rows.select(F.col("w0").alias("m"), F.round("c", 9).alias("c"))


def _one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string"}
    return local_frame(spark, [tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _all_terms(p) -> DataFrame:
    """The table of a Heisenberg propagator, its core among the terms."""
    return _public(p.evolved_frame(atol=0.0, digits=None))


# --- circuits and propagators ---------------------------------------------------------------------------------


def gate(basis: str, mask: int, width: int = MODES, coefficient: float = 1.0, index: int | None = None) -> ExpGate:
    if basis == "pauli":
        return ExpGate(PauliOperator({Pauli.from_mask(mask): coefficient}, width), index)
    return ExpGate(MajoranaOperator({B.slots_of(mask): coefficient}, width), index, structural=True)


def circuit(basis: str, gates, width: int = MODES, bound: bool = True) -> Circuit:
    """The circuit whose rotations an operator passes in this order: its gates act in the reverse one."""
    gates = gates[::-1]
    return Circuit([gate(basis, g, width) for g, _ in gates], width, [a for _, a in gates] if bound else (), STATE)


def gates_of(basis: str, n: int | None = None):
    return (PAULI_GATES if basis == "pauli" else MAJORANA_GATES)[:n]


def angles(gates) -> list[float]:
    return [a for _, a in gates[::-1]]


def propagator(terms: DataFrame, basis: str = "pauli", width: int = MODES, cutoff: int = SLOTS, **more):
    kind = PauliPropagator if basis == "pauli" else MajoranaPropagator
    return kind.from_frame(terms, width, STATE, cutoff=cutoff, **more)


def _propagated(basis: str, n: int, **settings) -> Callable:
    """settings: of the propagator, buckets=True to go through the shuffle however small the table is, and len_k."""

    def query(spark, sf_dir):
        own = dict(settings)
        buckets, len_k = own.pop("buckets", False), own.pop("len_k", None)
        p = propagator(operator(spark, sf_dir), basis, **own)
        if buckets:
            p.local_rows = 0
        p.propagate(circuit(basis, gates_of(basis, n)), only_rotate_len_k=len_k)
        return _all_terms(p)

    return query


def _with_graph(spark, sf_dir, basis="pauli", n=3, cutoff=4, **more):
    p = propagator(operator(spark, sf_dir), basis, cutoff=cutoff, **more)
    p.build_graph(circuit(basis, gates_of(basis, n)))
    return p, angles(gates_of(basis, n))


def _expval(basis: str, shift: float = 0.0) -> Callable:
    gates = [(g, a + shift * (i == 0)) for i, (g, a) in enumerate(gates_of(basis, 3))]

    def query(spark, sf_dir):
        p = propagator(operator(spark, sf_dir), basis)
        p.propagate(circuit(basis, gates))
        return _one_row(spark, expval=round(p.expectation_value(), 6))

    return query


def _term(expressions: dict[str, str]) -> Callable:
    def query(spark, sf_dir):
        return operator(spark, sf_dir).selectExpr("w0 AS m", *[f"{e} AS {n}" for n, e in expressions.items()])

    return query


def _gate(basis: str, at: int, cut: Truncation = OPEN, schrodinger: bool = False) -> Callable:
    g, angle = gates_of(basis)[at]

    def query(spark, sf_dir):
        return _public(rotate(operator(spark, sf_dir), Algebra(basis, 1), g, angle, cut, schrodinger, OCCUPIED))

    return query


def _evolved(rows: DataFrame, basis: str, gates, cut: Truncation, batch: bool = True) -> DataFrame:
    """Without a propagator: one shuffle per gate in SQL, or one per batch in the kernel."""
    algebra = Algebra(basis, 1)
    if not batch:
        for g, angle in gates:
            rows = rotate(rows, algebra, g, angle, cut)
        return rows
    rows = rows.withColumn("layer", F.lit(-1))
    for part in batches([Rotation(g, a, i) for i, (g, a) in enumerate(gates)]):
        rows = evolve(rows, algebra, part, cut)
    return rows.select("w0", "c")


# --- graphs ---------------------------------------------------------------------------------------------------


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_graph(spark, sf_dir)[0].graph_edges().select(F.col("w0").alias("m"), "layer")


def graph_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph built without angles: the tolerances do not count."""
    p = propagator(operator(spark, sf_dir), cutoff=4, lower_atol=0.01)
    p.build_graph(circuit("pauli", PAULI_GATES[:3], bound=False))
    return p.graph_edges().select(F.col("w0").alias("m"), "layer")


def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_graph(spark, sf_dir)[0].graph_counts()


def graph_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two layers of a graph, and how many pairs each rotates."""
    return _with_graph(spark, sf_dir)[0].graph_edges(2).groupBy("layer").agg(F.count(F.lit(1)).alias("pairs"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, values = _with_graph(spark, sf_dir)
    return _public(p.evolved_frame(values, atol=0.0, digits=None))


def replayed_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the shuffle, with batches of few dimensions."""
    p = propagator(operator(spark, sf_dir), cutoff=4, max_rank=2)
    p.local_rows = p.local_limit = 0
    p.build_graph(circuit("pauli", PAULI_GATES[:3]))
    return _public(p.evolved_frame(angles(PAULI_GATES[:3]), atol=0.0, digits=None))


def contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph folded into the operator, which is then rotated on."""
    p, values = _with_graph(spark, sf_dir, n=2)
    p.contract_partially(values)
    p.propagate(circuit("pauli", PAULI_GATES[2:3]))
    return _all_terms(p)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second circuit appended to a graph with angles for the whole of it."""
    p, values = _with_graph(spark, sf_dir, n=2)
    every = [*values, PAULI_GATES[2][1]]
    p.build_graph(circuit("pauli", PAULI_GATES[2:3], bound=False), seed_parameters=every)
    return _public(p.evolved_frame(every, atol=0.0, digits=None))


def replay_expval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, values = _with_graph(spark, sf_dir)
    return _one_row(spark, expval=round(p.expectation_value(values), 6))


def rewired_expval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three layers driven by one angle."""
    p, _ = _with_graph(spark, sf_dir, cutoff=SLOTS)
    p.parameter_mapping = [0, 0, 0]
    return _one_row(spark, expval=round(p.expectation_value([0.35]), 6), parameters=p.n_parameters)


def functional_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reusable functional, whole and pared, at the graph's own angles."""
    p, values = _with_graph(spark, sf_dir)
    rows = [(name, round(p.expval_functional(threshold)(values), 6)) for name, threshold in (("whole", None), ("pared", 0.5))]
    return local_frame(spark, rows, "functional string, expval double")


def _slopes(spark, p, values, f) -> DataFrame:
    slopes = f(values)[1]
    return local_frame(spark, [(len(values) - 1 - i, round(float(s), 6)) for i, s in enumerate(slopes)], "layer int, slope double")


def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d expval / d angle of each layer, by one sweep back; layers in the order in which the operator passes them."""
    p, values = _with_graph(spark, sf_dir, cutoff=SLOTS)
    return _slopes(spark, p, values, p.expectation_value_and_gradient)


def functional_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, values = _with_graph(spark, sf_dir, cutoff=SLOTS)
    return _slopes(spark, p, values, p.expectation_value_and_gradient_functional(0.5))


def pare_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that can reach the expectation value: ends of rotated pairs, and paired terms."""
    return _with_graph(spark, sf_dir)[0].pared_terms(0.5).select(F.col("w0").alias("m"))


# --- pictures and settings ------------------------------------------------------------------------------------


def schrodinger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a Schroedinger propagator: all paired monomials of at most three pairs, with their state phases."""
    return _public(propagator(operator(spark, sf_dir), "majorana", schrodinger_cutoff=6).terms())


def _schrodinger(spark, sf_dir):
    p = propagator(operator(spark, sf_dir), "majorana", schrodinger_cutoff=SLOTS)
    p.propagate(Circuit([gate("majorana", g) for g, _ in MAJORANA_GATES[:2]], MODES, [a for _, a in MAJORANA_GATES[:2]], STATE))
    return p


def propagate_schrodinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after two gates, first gate first."""
    return _public(_schrodinger(spark, sf_dir).terms())


def schrodinger_expval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's terms that the state holds, weighed with it."""
    return _one_row(spark, expval=round(_schrodinger(spark, sf_dir).expectation_value(), 6))


def picture_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rotation's expectation value in both pictures: operator rotated, and state rotated."""
    rows = []
    for name, more in (("heisenberg", {}), ("schrodinger", {"schrodinger_cutoff": SLOTS})):
        p = propagator(operator(spark, sf_dir), "majorana", **more)
        p.propagate(circuit("majorana", MAJORANA_GATES[:1]))
        rows.append((name, round(p.expectation_value(), 6)))
    return local_frame(spark, rows, "picture string, expval double")


def gate_basis_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners measured by their length in the Jordan-Wigner image."""
    p = propagator(operator(spark, sf_dir), "majorana", cutoff=8)
    p.basis_change = jordan_wigner_basis_change(MODES)
    p.propagate(circuit("majorana", MAJORANA_GATES[1:2]))
    return _all_terms(p)


def gate_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate of one's own: no partner may hold slot 9."""
    away = Predicate(lambda w: f"({w[0]} & 512L) = 0L", lambda m: (m[..., 0] >> 9 & 1) == 0)
    p = propagator(operator(spark, sf_dir), cutoff=SLOTS, predicate=away)
    p.propagate(circuit("pauli", PAULI_GATES[:1]))
    return _all_terms(p)


def untouched_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two gates the one on a qubit that no term holds is skipped."""
    p = propagator(operator(spark, sf_dir), width=MODES + 2)
    p.propagate(circuit("pauli", [PAULI_GATES[0], (B.mask_of((2 * MODES + 2,)), 0.4)], MODES + 2))
    return _all_terms(p)


def identity_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate whose terms are all below the generator's tolerance goes, and so does its angle."""
    gates = [gate("pauli", PAULI_GATES[0][0]), gate("pauli", PAULI_GATES[1][0], coefficient=1e-9)]
    p = propagator(operator(spark, sf_dir))
    p.propagate(Circuit(gates, MODES, [PAULI_GATES[0][1], 0.9], STATE))
    return _all_terms(p)


def circuit_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two circuits one after the other, each with its own angles."""
    both = circuit("pauli", PAULI_GATES[2:3]) + circuit("pauli", PAULI_GATES[:2])
    return _all_terms(PauliPropagator.from_circuit(both, operator(spark, sf_dir), cutoff=5, lower_atol=0.001))


def copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that is rotated leaves its original as it was."""
    p = propagator(operator(spark, sf_dir))
    copy.deepcopy(p).propagate(circuit("pauli", PAULI_GATES[:2]))
    return _all_terms(p)


def update_initial_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing terms take the new weights, the others 0: the new operator is that of the returned items."""
    rows = lineitem(spark, sf_dir).where("l_returnflag = 'R'").selectExpr(f"{KEY} & {(1 << SLOTS) - 1}L AS w0", "CAST(l_quantity AS BIGINT) AS q")
    p = propagator(operator(spark, sf_dir).where("w0 <> 0"))
    p.update_initial_operator(rows.where("w0 <> 0").groupBy("w0").agg(F.sum("q").cast("double").alias("c")))
    return _public(p.terms())


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _with_graph(spark, sf_dir)
    held = p.memory()
    return _one_row(spark, terms=p.size(), term_bytes=held["term_bytes"], edges=held["edges"], edge_bytes=held["edge_bytes"], gates=p.n_gates, parameters=p.n_parameters, layers=p.graph_layers)


def core_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity's coefficient is no row, and part of every expectation value."""
    one = local_frame(spark, [(0, 0.75), (0, 0.5)], "w0 long, c double")
    p = propagator(operator(spark, sf_dir).where("w0 <> 0").unionByName(one))
    return _one_row(spark, core=p.core, terms=p.size(), expval=round(p.expectation_value(), 6))


def evolved_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evolved operator's sink: coefficients of at least 0.02, rounded."""
    p = propagator(operator(spark, sf_dir), "majorana")
    p.propagate(circuit("majorana", MAJORANA_GATES[:2]))
    return _public(p.evolved_frame(atol=0.02).where("abs(c) >= 0.02"))  # the core, too


def norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without truncation the sum of squares is conserved."""
    start = operator(spark, sf_dir)
    both = [("before", start), ("after", _evolved(start, "majorana", MAJORANA_GATES, OPEN))]
    parts = [df.agg(F.round(F.sum(F.col("c") * F.col("c")), 4).alias("norm")).select(F.lit(n).alias("step"), "norm") for n, df in both]
    return parts[0].unionByName(parts[1])


def isclose_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term-wise comparison of an operator with its rotation, over the union of their terms."""
    a = operator(spark, sf_dir)
    return frames.is_close(a, rotate(a, Algebra("pauli", 1), *PAULI_GATES[0], OPEN), 1)


# --- authoring ------------------------------------------------------------------------------------------------


def _idx(rows: DataFrame) -> DataFrame:
    return rows.withColumn("idx", F.concat_ws(",", F.transform("idx", lambda x: x.cast("string"))))


def majorana_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four Majoranas per line, in any order and with repeats, brought to normal order and merged."""
    idx = "array(CAST(l_partkey % 16 AS INT), CAST(l_suppkey % 16 AS INT), CAST(l_linenumber % 16 AS INT), CAST(l_quantity AS INT) % 16)"
    return _idx(frames.normal_ordered(lineitem(spark, sf_dir).selectExpr(f"{idx} AS idx", "CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS re", "-1D AS im")))


def _ladders(spark, sf_dir, modes: str, raising: str) -> DataFrame:
    return lineitem(spark, sf_dir).selectExpr(f"transform(array({modes}), m -> CAST(m AS INT)) AS modes", f"array({raising}) AS raising", "CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS c")


def ladder_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hopping terms as Majorana products."""
    return _idx(frames.majoranas_of_ladders(_ladders(spark, sf_dir, "l_partkey % 8, l_suppkey % 8", "true, false")))


def ladder_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.canonical_ladders(_ladders(spark, sf_dir, "l_partkey % 8, l_suppkey % 8, l_linenumber", "false, true, false"))
    return rows.select(F.concat_ws(",", F.zip_with("modes", "raising", lambda m, up: F.concat(m.cast("string"), F.when(up, "+").otherwise("-")))).alias("ladder"), "c")


def integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder terms of integrals over four orbitals, summed from all lines."""
    rows = lineitem(spark, sf_dir).selectExpr("CAST(l_partkey % 4 AS INT) AS p", "CAST(l_suppkey % 4 AS INT) AS q", "CAST(l_orderkey % 4 AS INT) AS r", "CAST(l_linenumber % 4 AS INT) AS t", "CAST(l_partkey DIV 4 % 3 AS INT) AS block", "CAST(l_quantity AS BIGINT) - 25 AS v")
    one = rows.groupBy((F.col("block") % 2).alias("spin"), "p", "q").agg((F.sum("v").cast("double") / 1024).alias("value"))
    two = rows.groupBy("block", "p", "q", "r", "t").agg((F.sum("v").cast("double") / 1024).alias("value"))
    out = frames.integral_ladders(one, two, 4, 0.5)
    return out.select(F.concat_ws(",", F.zip_with("modes", "raising", lambda m, up: F.concat(m.cast("string"), F.when(up, "+").otherwise("-")))).alias("ladder"), F.round("c", 9).alias("c"))


def jordan_wigner_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauli terms as Majorana products."""
    return _public(frames.jordan_wigner_rows(operator(spark, sf_dir), MODES))


def decoded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored coefficients of the stored Majorana terms."""
    return _idx(frames.decoded(operator(spark, sf_dir), MODES))


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(frames.encoded(frames.decoded(operator(spark, sf_dir), MODES), MODES))


def slots_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit string to ascending slots, and back."""
    rows = tables.slots_of_words(operator(spark, sf_dir), MODES)
    back = tables.words_of(rows.select("idx", "c"), MODES).select(F.col("w0").alias("back"), F.col("c").alias("d"))
    rows = rows.select(F.col("w0").alias("m"), F.concat_ws(",", F.transform("idx", lambda x: x.cast("string"))).alias("slots"), "c")
    return rows.join(back, F.col("m") == F.col("back")).where("c = d").select("m", "slots", "back")


def pauli_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each Pauli term, one per qubit, also as external packages write them; and back."""
    rows = frames.pauli_labels(operator(spark, sf_dir), MODES).withColumnRenamed("w0", "m").withColumn("letters", F.col("label"))
    rows = frames.pauli_words(rows, MODES).withColumnRenamed("w0", "back").drop("label")
    rows = frames.pauli_labels(rows.withColumn("w0", F.col("m")), MODES, reverse=True)
    return rows.select("m", "letters", F.col("label").alias("reversed"), "back")


def gate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rotations, one per line, as generators: how often each occurs."""
    rows = lineitem(spark, sf_dir).selectExpr(
        "element_at(array('rx', 'rzz', 'ryy', 'barrier', 'rxz'), CAST(l_linenumber % 5 AS INT) + 1) AS name", "CAST(l_partkey % 8 AS INT) AS a", "CAST((l_partkey + 1 + l_suppkey % 7) % 8 AS INT) AS b", "l_discount AS value"
    )
    gates = frames.rotations_of(rows.selectExpr("name", "if(name = 'rx', array(a), array(a, b)) AS qubits", "value"))
    return _idx(gates.groupBy("idx", "gcoef").agg(F.count(F.lit(1)).alias("gates"), F.round(F.sum("angle"), 6).alias("angle")))


def gate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of neighbours with an equal parameter: how a dense gate list becomes gates."""
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    gates = tables.gate_sessions(rows, ("l_orderkey",), ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_returnflag")
    return gates.groupBy("l_orderkey", "gate").agg(F.count(F.lit(1)).alias("terms"))


def commuting_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the terms of each order's generator commute, in either basis."""
    rows = lineitem(spark, sf_dir).selectExpr("l_orderkey AS gate", f"{KEY} & {(1 << SLOTS) - 1}L AS w0")
    both = [frames.products_commute(rows, 1, basis).withColumnRenamed("commute", basis) for basis in ("pauli", "majorana")]
    return both[0].join(both[1], "gate")


def problem_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole problem, its operator the sums per region, written and read again."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("s")).orderBy("n_regionkey").collect()  # five regions
    op = MajoranaOperator({(r["n_regionkey"], r["n_regionkey"] + 2): 1j * r["s"] for r in rows}, MODES)
    problem = tables.Problem(op, circuit("majorana", MAJORANA_GATES[:2]), 0.25, [0.5])
    path = f"{shared_folder(spark)}/bitweave-problem-{spark.sparkContext.applicationId}-{id(problem)}"
    tables.write_problem(spark, problem, path)
    back = tables.read_problem(spark, path)
    found = frames.encoded(local_frame(spark, [(list(k), v.real, v.imag) for k, v in back.operator.terms.items()], tables.TERMS), MODES)
    return _public(found).withColumn("gates", F.lit(len(back.circuit))).withColumn("energy", F.lit(back.energy))


def ising_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Trotter steps of a 2 x 2 Ising lattice with tilted field, built by the model and evolved."""
    op, steps = tilted_ising(2, 2, 2)
    return _public(PauliPropagator.from_circuit(steps, op, cutoff=4).evolved_frame())


# --- trotter steps and wide systems ---------------------------------------------------------------------------


def ising_gates(steps: int, qubits: int, dt: float = 0.05, j: float = 1.5, hx: float = 1.0, hz: float = 1.0) -> list[tuple[int, float]]:
    bonds = [(B.mask_of((2 * q, 2 * q + 1, 2 * q + 2, 2 * q + 3)), -j * dt) for q in range(qubits - 1)]
    fields = [(B.mask_of((2 * q,)), -hx * dt) for q in range(qubits)] + [(B.mask_of((2 * q, 2 * q + 1)), -hz * dt) for q in range(qubits)]
    return (bonds + fields) * steps


def trotter_ising(spark: SparkSession, sf_dir: str, steps: int = 2, qubits: int = 8) -> DataFrame:
    """Trotter steps of a tilted-field Ising chain: ZZ bonds, then X and Z fields."""
    p = propagator(operator(spark, sf_dir), cutoff=5, lower_atol=1e-3)
    p.propagate(circuit("pauli", ising_gates(steps, qubits)))
    return _all_terms(p)


def wide_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(rotate(wide_operator(spark, sf_dir), Algebra("pauli", 1), *WIDE_GATES[0], Truncation(12, "support")))


def wide_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propagator(wide_operator(spark, sf_dir), width=24, cutoff=12)
    p.propagate(circuit("pauli", WIDE_GATES, 24))
    return _all_terms(p)


def wide_trotter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Trotter step on twelve of 24 qubits; a rotation below 0.004 is left out."""
    p = propagator(wide_operator(spark, sf_dir), width=24, cutoff=10, lower_atol=0.004)
    p.propagate(circuit("pauli", ising_gates(1, 12), 24))
    return _all_terms(p)


def wide_expval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = propagator(wide_operator(spark, sf_dir), width=24, cutoff=12)
    p.propagate(circuit("pauli", WIDE_GATES, 24))
    return _one_row(spark, expval=round(p.expectation_value(), 6), terms=p.size())


def wide_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = WIDE_GATES[:3]
    p = propagator(wide_operator(spark, sf_dir), width=24, cutoff=24)
    p.build_graph(circuit("pauli", gates, 24))
    return _slopes(spark, p, angles(gates), p.expectation_value_and_gradient)


def two_word_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-four qubits, two words."""
    p = propagator(two_word_operator(spark, sf_dir), width=64, cutoff=18)
    p.propagate(circuit("pauli", TWO_WORD_GATES, 64))
    return p.evolved_frame(atol=0.0, digits=None).select("w0", "w1", F.round("c", 9).alias("c"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    maj, pauli = Algebra("majorana", 1), Algebra("pauli", 1)
    g, p, w = MAJORANA_GATES[1][0], PAULI_GATES[1][0], ["w0"]
    triple = MAJORANA_GATES[2][0]
    image = B.changed_basis(w, [B.mask_of(r) for r in jordan_wigner_basis_change(MODES)])
    return {
        "op_merge": lambda s, d: _public(merge(operator(s, d).unionByName(operator(s, d)), 1)),
        "op_popcount": _term({"length": B.popcount(w)}),
        "op_support": _term({"support": B.support(w)}),
        "op_paired": _term({"paired": B.paired(w)}),
        "op_state_phase": _term({"majorana": f"CAST({maj.state_phase(w, OCCUPIED)} AS INT)", "pauli": f"CAST({pauli.state_phase(w, OCCUPIED)} AS INT)"}),
        "antihermitian": _term({"antihermitian": maj.antihermitian(w)}),
        "maj_anticommute": _term({"even_g": maj.anticommutes(w, g), "odd_g": maj.anticommutes(w, triple)}),
        "pauli_anticommute": _term({"ac": pauli.anticommutes(w, p)}),
        "partner": _term({"partner": B.xored(w, g)[0], "pair_key": B.least(w, B.xored(w, g))[0]}),
        "interleave_sign": _term({"sign": maj.interleave_sign(w, g)}),
        "hermitian_phase": _term({"phase": f"if({maj.anticommutes(w, g)}, {maj.phase(w, g)}, 0)"}),
        "pauli_sign": _term({"phase": f"if({pauli.anticommutes(w, p)}, {pauli.phase(w, p)}, 0)"}),
        "jw_support": lambda s, d: operator(s, d).selectExpr("w0 AS m", f"{image[0]} AS image").selectExpr("m", "image", f"{B.support(['image'])} AS support"),
        "maj_gate": _gate("majorana", 1),
        "maj_gate_odd": _gate("majorana", 2),
        "pauli_gate": _gate("pauli", 0),
        "gate_length": _gate("majorana", 1, Truncation(8)),
        "gate_support": _gate("pauli", 1, Truncation(5, "support")),
        "gate_lower_atol": _gate("pauli", 2, Truncation(5, "support", lower=0.005)),
        "gate_upper_atol": _gate("pauli", 2, Truncation(4, "support", lower=0.005, upper=0.02)),
        "gate_len_k": _gate("majorana", 0, Truncation(10, longest_source=8)),
        "schrodinger_gate": _gate("majorana", 0, OPEN, True),
        "gate_basis_change": gate_basis_change,
        "gate_predicate": gate_predicate,
        "circuit_3": lambda s, d: _public(_evolved(operator(s, d), "pauli", PAULI_GATES[:3], Truncation(5, "support", lower=0.001), False)),
        "maj_circuit_batch": lambda s, d: _public(_evolved(operator(s, d), "majorana", MAJORANA_GATES[:3], Truncation(9))),
        "circuit_batch": _propagated("pauli", 3, cutoff=5, lower_atol=0.001),
        "propagate_buckets": _propagated("pauli", 3, cutoff=5, lower_atol=0.001, buckets=True, max_rank=2),
        "propagate_majorana": _propagated("majorana", 3, cutoff=9),
        "propagate_tolerances": _propagated("majorana", 2, cutoff=6, lower_atol=0.003, upper_atol=0.03),
        "propagate_len_k": _propagated("majorana", 1, cutoff=10, len_k=8),
        "propagate_schrodinger": propagate_schrodinger,
        "untouched_gate": untouched_gate,
        "identity_dropped": identity_dropped,
        "circuit_sum": circuit_sum,
        "copied": copied,
        "expval": _expval("pauli"),
        "maj_expval": _expval("majorana"),
        "expval_shifted": _expval("pauli", math.pi / 4),
        "schrodinger_expval": schrodinger_expval,
        "core_term": core_term,
        "gradient": gradient,
        "functional_value": functional_value,
        "functional_gradient": functional_gradient,
        "norm_check": norm_check,
        "graph_edges": graph_edges,
        "graph_structural": graph_structural,
        "graph_size": graph_size,
        "graph_slice": graph_slice,
        "replay": replayed,
        "replay_buckets": replayed_in_buckets,
        "contract": contracted,
        "graph_seeded": seeded,
        "replay_expval": replay_expval,
        "rewired_expval": rewired_expval,
        "pare_mask": pare_mask,
        "sizes": sizes,
        "trotter_ising": trotter_ising,
        "update_initial_operator": update_initial_operator,
        "isclose_join": isclose_join,
        "slot_postings": lambda s, d: propagator(operator(s, d)).slot_counts(),
        "row_parity": lambda s, d: propagator(operator(s, d)).row_parity(),
        "majorana_products": majorana_products,
        "ladder_expand": ladder_expand,
        "ladder_canonical": ladder_canonical,
        "integrals": integrals,
        "jw_map": jordan_wigner_map,
        "decoded_terms": decoded_terms,
        "encode_decode": encode_decode,
        "slots_round_trip": slots_round_trip,
        "pauli_strings": pauli_strings,
        "gate_list": gate_list,
        "gate_groups": gate_groups,
        "commuting_generators": commuting_generators,
        "problem_fixture": problem_fixture,
        "evolved_sink": evolved_sink,
        "schrodinger_state": schrodinger_state,
        "picture_agreement": picture_agreement,
        "ising_model": ising_model,
        "wide_gate": wide_gate,
        "wide_circuit": wide_circuit,
        "wide_trotter": wide_trotter,
        "wide_expval": wide_expval,
        "wide_gradient": wide_gradient,
        "two_word_circuit": two_word_circuit,
    }
