"""Operators, circuits and whole problems as tables, in any format that Spark reads and writes.

terms(idx ARRAY<INT>, re DOUBLE, im DOUBLE); gates(layer INT, gate INT, param INT, idx ARRAY<INT>, gcoef DOUBLE), with
structural coefficients; problem(num_modes INT, initial_state ARRAY<INT>, parameters ARRAY<DOUBLE>, energy DOUBLE,
gradient ARRAY<DOUBLE>).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits as B
from ..operators.circuit import Circuit, ExpGate
from ..operators.terms import MajoranaOperator, Pauli, PauliOperator
from ..store import local_frame

TERMS = "idx array<int>, re double, im double"
GATES = "layer int, gate int, param int, idx array<int>, gcoef double"
PROBLEM = "num_modes int, initial_state array<int>, parameters array<double>, energy double, gradient array<double>"


def words_of(terms: DataFrame, num_modes: int) -> DataFrame:
    """(idx, c) rows as (w0.., c), like terms merged; for operators too large for the driver."""
    words = B.word_count(num_modes)
    checked = F.when(F.exists("idx", lambda i: (i < 0) | (i >= 2 * num_modes)), F.raise_error(F.lit("index out of range"))).otherwise(F.lit(0).cast("long"))
    cols = [F.expr(f"aggregate(filter(idx, i -> i div 64 = {w}), 0L, (a, i) -> a ^ shiftleft(1L, CAST(i % 64 AS INT)))") + checked for w in range(words)]
    rows = terms.select(*[c.alias(n) for c, n in zip(cols, B.word_names(words))], "c")
    return rows.groupBy(*B.word_names(words)).agg(F.sum("c").alias("c"))


def slots_of_words(rows: DataFrame, num_modes: int) -> DataFrame:
    """(w0.., ..) rows with idx, the ascending slots, in front."""
    slots = "concat(" + ", ".join(f"filter(sequence({64 * i}, {64 * i + 63}), s -> shiftrightunsigned({n}, s - {64 * i}) & 1L = 1L)" for i, n in enumerate(B.word_names(B.word_count(num_modes)))) + ")"
    return rows.withColumn("idx", F.expr(slots))


def write_operator(spark: SparkSession, operator, path: str, fmt: str = "parquet") -> None:
    masks = operator.masks()
    local_frame(spark, [(list(B.slots_of(m)), complex(c).real, complex(c).imag) for m, c in masks.items()], TERMS).write.format(fmt).save(path)


def read_operator(spark: SparkSession, path: str, num_modes: int, fmt: str = "parquet", basis: str = "majorana"):
    """The operator on the driver; see words_of for large ones."""
    rows = spark.read.format(fmt).schema(TERMS).load(path).groupBy("idx").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect()
    if basis == "pauli":
        return PauliOperator.from_lists([Pauli.from_mask(B.mask_of(r["idx"])) for r in rows], [r["re"] for r in rows], num_modes)
    return MajoranaOperator.from_lists([tuple(r["idx"]) for r in rows], [complex(r["re"], r["im"]) for r in rows], num_modes)


def write_circuit(spark: SparkSession, circuit: Circuit, path: str, fmt: str = "parquet") -> None:
    flat = circuit.layers()
    rows = [(i, g, p, list(B.slots_of(m)), c) for i, (m, c, p, g) in enumerate(zip(flat.masks, flat.coefficients, flat.mapping, flat.gates))]
    local_frame(spark, rows, GATES).write.format(fmt).save(path)


def gate_sessions(gates: DataFrame, circuit: tuple[str, ...] = (), order: tuple[str, ...] = ("layer",), param: str = "param") -> DataFrame:
    """gate numbers from the parameter alone: neighbours in the given order with an equal one are one gate. With circuit
    columns each circuit is numbered for itself; without, the table is one circuit, whose length bounds the ordering."""
    by = Window.partitionBy(*circuit).orderBy(*order)
    new = F.coalesce((~F.lag(param).over(by).eqNullSafe(F.col(param))).cast("int"), F.lit(0))
    first = F.row_number().over(by) == 1
    gates = gates.withColumn("_new", F.when(first, 0).otherwise(new))
    return gates.withColumn("gate", F.sum("_new").over(by).cast("int")).drop("_new")


def read_circuit(spark: SparkSession, path: str, num_modes: int, fmt: str = "parquet", parameters=(), initial_state=None, basis: str = "majorana") -> Circuit:
    rows = spark.read.format(fmt).schema(GATES).load(path).orderBy("layer").collect()
    if basis == "majorana":
        return Circuit.from_dense_arrays([tuple(r["idx"]) for r in rows], [r["gcoef"] for r in rows], [r["param"] for r in rows], num_modes, parameters, initial_state)
    gates, last = [], None
    for r in rows:
        if last != r["gate"]:
            gates.append(({}, r["param"]))
            last = r["gate"]
        gates[-1][0][Pauli.from_mask(B.mask_of(r["idx"]))] = r["gcoef"]
    return Circuit([ExpGate(PauliOperator(t, num_modes), p, atol=0.0) for t, p in gates], num_modes, parameters, initial_state)


@dataclass
class Problem:
    operator: MajoranaOperator
    circuit: Circuit
    energy: float | None
    gradient: list[float]


def write_problem(spark: SparkSession, problem: Problem, path: str) -> None:
    write_operator(spark, problem.operator, f"{path}/terms")
    write_circuit(spark, problem.circuit, f"{path}/gates")
    c = problem.circuit
    row = (c.system_size, list(c.initial_state), list(c.parameters), problem.energy, list(problem.gradient))
    local_frame(spark, [row], PROBLEM).write.parquet(f"{path}/problem")


def read_problem(spark: SparkSession, path: str) -> Problem:
    row = spark.read.schema(PROBLEM).parquet(f"{path}/problem").first()
    n = row["num_modes"]
    circuit = read_circuit(spark, f"{path}/gates", n, parameters=row["parameters"], initial_state=row["initial_state"])
    return Problem(read_operator(spark, f"{path}/terms", n), circuit, row["energy"], row["gradient"])
