"""Propagation of operators and states through circuits, as DataFrames of monomials."""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ModeCountError, StaleFunctionalError
from .functions import bits as B
from .functions.algebra import Algebra, occupied_mask, swapped
from .operators.circuit import Circuit, validate_parameter_mapping
from .operators.terms import MajoranaOperator, Pauli, PauliOperator
from .plans.batch import COSINE, DONE, EDGE, ROW, Rotation, batches, evenly, evolve, replay, replay_back
from .plans.rotate import merge
from .plans.truncation import Predicate, Truncation
from .store import discard, keep, local_frame

MAX_NUM_MODES = 1 << 16


@dataclass
class Layer:
    """One rotation of a graph: its build number (never reused), generator, coefficient, parameter and gate."""

    number: int
    g: int
    coefficient: float
    parameter: int
    gate: int


@dataclass
class Graph:
    """Layers in the order in which the operator passes them, and where each was built."""

    layers: list[Layer] = field(default_factory=list)
    edges: DataFrame | None = None  # w0.., layer: lower end of each rotated pair
    cosine_only: DataFrame | None = None  # layer, n


class Propagator:
    """Shared by both families. The terms live in a table (w0.., c, layer) written to the shared folder.

    Heisenberg picture: the table is the operator. Schroedinger picture (schrodinger_cutoff given): the table is the
    state, and the operator is a table of its own. The identity's coefficient is kept apart as `core`.
    """

    basis = "majorana"
    rows_per_bucket = 500_000
    batches_per_write = 4
    #: A table of at most local_rows is rotated in one task, gate after gate, until it has more than local_limit.
    local_rows = 250_000
    local_limit = 1_000_000

    def __init__(
        self,
        initial_operator,
        initial_state,
        *,
        cutoff: int,
        schrodinger_cutoff: int | None = None,
        cutoff_type: str = "length",
        lower_atol: float | None = None,
        upper_atol: float | None = None,
        predicate: Predicate | None = None,
        spark: SparkSession | None = None,
        max_rank: int | None = None,
    ):
        masks, size = self._terms_of(initial_operator)
        self._configure(size, initial_state, Truncation(cutoff, cutoff_type, lower_atol, upper_atol, predicate=predicate), max_rank, spark)
        self._start(*self._split_core(masks), schrodinger_cutoff)

    def _configure(self, size: int, initial_state, cut: Truncation, max_rank: int | None, spark: SparkSession | None) -> None:
        if size <= 0 or size > MAX_NUM_MODES:
            raise ModeCountError(f"number of modes must be in 1..{MAX_NUM_MODES}: {size}")
        self._size, self._state = size, tuple(int(i) for i in initial_state)
        if len(set(self._state)) != len(self._state) or any(not 0 <= i < size for i in self._state):
            raise ValueError(f"the initial state must hold distinct indices in 0..{size - 1}")
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.algebra = Algebra(self.basis, B.word_count(size))
        self._occupied = occupied_mask(self._state)
        self._cut = cut
        self.max_rank = max_rank
        self._names = B.word_names(self.algebra.words)

    def _start(self, core: float, operator: DataFrame, schrodinger_cutoff: int | None) -> None:
        self.core, self._operator = core, operator
        self.schrodinger = schrodinger_cutoff is not None
        self._rows = keep(self._paired_state(schrodinger_cutoff)) if self.schrodinger else operator.withColumn("layer", F.lit(-1))
        self._graph, self._built, self._n_params = Graph(), 0, 0
        self._operator_epoch = self._graph_epoch = 0
        self.shuffles = 0  # batches that went through a shuffle so far
        self._even: dict[frozenset, bool] = {}

    # --- construction

    @classmethod
    def from_frame(cls, terms: DataFrame, num_modes: int, initial_state=(), *, cutoff: int, schrodinger_cutoff: int | None = None, cutoff_type: str | None = None, lower_atol: float | None = None, upper_atol: float | None = None, predicate: Predicate | None = None, max_rank: int | None = None):
        """A propagator whose operator is a table, of any size; nothing of it is collected but the identity's coefficient.

        terms: (w0.., c) with real stored coefficients (see sources.tables.encoded for authored ones); like terms add up.
        """
        out = cls.__new__(cls)
        kind = cls._cutoff_type(cutoff_type)
        out._configure(num_modes, initial_state, Truncation(cutoff, kind, lower_atol, upper_atol, predicate=predicate), max_rank, terms.sparkSession)
        limit = schrodinger_cutoff if schrodinger_cutoff is None or cls.basis == "majorana" else 2 * schrodinger_cutoff
        out._start(*out._split_frame(terms), limit)
        return out

    @classmethod
    def _cutoff_type(cls, given: str | None) -> str:
        return given or "length"

    def _terms_of(self, operator) -> tuple[dict[int, complex], int]:
        op = operator.get_majorana_operator()
        return op.masks(), op.num_modes

    def _split_core(self, masks: dict[int, complex]) -> tuple[float, DataFrame]:
        encoded = {m: self.algebra.encode(m, c) for m, c in masks.items()}
        core = encoded.pop(0, 0.0)
        rows = [(*B.split(m, self.algebra.words), c) for m, c in encoded.items()]
        schema = ", ".join(f"{n} long" for n in self._names) + ", c double"
        return core, local_frame(self.spark, rows, schema)

    def _split_frame(self, terms: DataFrame) -> tuple[float, DataFrame]:
        """The identity's coefficient, and the other terms, merged and written."""
        merged = keep(merge(terms.select(*[F.col(n).cast("long").alias(n) for n in self._names], F.col("c").cast("double").alias("c")), self.algebra.words))
        identity = " AND ".join(f"{n} = 0" for n in self._names)
        return merged.where(identity).agg(F.sum("c")).first()[0] or 0.0, merged.where(f"NOT ({identity})")

    def _paired_state(self, limit: int) -> DataFrame:
        """All paired monomials of at most ceil(limit / 2) pairs, each with its state phase; grown pair by pair in Spark."""
        most = min(-(-min(limit, 2 * self._size) // 2), self._size)
        pairs = local_frame(self.spark, [(q, *B.split(3 << 2 * q, self.algebra.words)) for q in range(self._size)], "q int, " + ", ".join(f"p{i} long" for i in range(self.algebra.words)))
        level = local_frame(self.spark, [(-1, *[0] * self.algebra.words)], "top int, " + ", ".join(f"{n} long" for n in self._names))
        out = level
        for _ in range(most):
            # the pairs table has one row per mode: a proven bound
            level = level.join(F.broadcast(pairs), F.col("q") > F.col("top")).selectExpr("q AS top", *[f"({n} | p{i}) AS {n}" for i, n in enumerate(self._names)])
            level = keep(level)
            out = out.unionByName(level)
        phase = self.algebra.state_phase(self._names, self._occupied)
        return out.selectExpr(*self._names, f"{phase} AS c", "-1 AS layer")

    @classmethod
    def from_circuit(cls, circuit: Circuit, initial_operator, **config):
        """Built with the circuit's initial state, and propagated through it. The operator may be a table (w0.., c)."""
        if isinstance(initial_operator, DataFrame):
            out = cls.from_frame(initial_operator, circuit.system_size, circuit.initial_state, **config)
        else:
            out = cls(initial_operator, circuit.initial_state, **config)
        out.propagate(circuit)
        return out

    # --- settings

    @property
    def cutoff(self) -> int:
        return self._cut.cutoff

    @cutoff.setter
    def cutoff(self, value: int) -> None:
        self._cut = replace(self._cut, cutoff=value)

    @property
    def cutoff_type(self) -> str:
        return self._cut.kind

    @cutoff_type.setter
    def cutoff_type(self, value: str) -> None:
        self._cut = replace(self._cut, kind=value)

    @property
    def predicate(self):
        return self._cut.predicate

    @predicate.setter
    def predicate(self, value: Predicate | None) -> None:
        self._cut = replace(self._cut, predicate=value)

    @property
    def lower_atol(self):
        return self._cut.lower

    @lower_atol.setter
    def lower_atol(self, value) -> None:
        self._cut = replace(self._cut, lower=value)

    @property
    def upper_atol(self):
        return self._cut.upper

    @upper_atol.setter
    def upper_atol(self, value) -> None:
        self._cut = replace(self._cut, upper=value)

    @property
    def basis_change(self):
        return None if self._cut.basis_rows is None else [list(B.slots_of(r)) for r in self._cut.basis_rows]

    @basis_change.setter
    def basis_change(self, rows) -> None:
        if rows is not None and self.basis == "pauli":
            raise ValueError("the Pauli basis takes no basis change")
        if rows is not None and len(rows) != 2 * self._size:
            raise ValueError(f"a basis change has {2 * self._size} rows")
        self._cut = replace(self._cut, basis_rows=None if rows is None else tuple(B.mask_of(r) for r in rows))

    @property
    def num_modes(self) -> int:
        return self._size

    @property
    def n_parameters(self) -> int:
        return self._n_params

    @property
    def n_gates(self) -> int:
        return max((x.gate for x in self._graph.layers), default=-1) + 1

    @property
    def graph_layers(self) -> int:
        return len(self._graph.layers)

    @property
    def parameter_mapping(self) -> list[int]:
        """The parameter of each layer, in the order in which the layers were given."""
        return [x.parameter for x in sorted(self._graph.layers, key=self._given_order)]

    def _given_order(self, x: Layer):
        return (x.gate, self._graph.layers.index(x) if self.schrodinger else -self._graph.layers.index(x))

    @parameter_mapping.setter
    def parameter_mapping(self, mapping) -> None:
        mapping = [int(m) for m in mapping]
        layers = sorted(self._graph.layers, key=self._given_order)
        if len(mapping) == len(layers):
            validate_parameter_mapping(mapping, len(layers), "graph layers")
            new = {id(x): m for x, m in zip(layers, mapping)}
        elif len(mapping) == self.n_gates:
            validate_parameter_mapping(mapping, self.n_gates, "gates")
            new = {id(x): mapping[x.gate] for x in layers}
        else:
            raise ValueError(f"the mapping has {len(mapping)} entries for {len(layers)} layers and {self.n_gates} gates")
        self._graph = replace(self._graph, layers=[replace(x, parameter=new[id(x)]) for x in self._graph.layers])
        self._n_params = max(mapping, default=-1) + 1

    # --- evolution

    def _check(self, circuit: Circuit, only_rotate_len_k: int | None) -> Truncation:
        if circuit.family not in ("empty", self.basis):
            raise TypeError(f"a {circuit.family} circuit cannot drive a {self.basis} propagator")
        if circuit.state_given and set(circuit.initial_state) != set(self._state):
            raise ValueError("the circuit's initial state is not the propagator's")
        if circuit.system_size != self._size:
            raise ValueError(f"circuit width {circuit.system_size}, propagator width {self._size}")
        if only_rotate_len_k is not None and not 0 < only_rotate_len_k <= 2 * self._size:
            raise ValueError(f"only_rotate_len_k must be in 1..{2 * self._size}")
        return replace(self._cut, longest_source=only_rotate_len_k)

    def _bind(self, parameters, needed: int) -> list[float]:
        values = [] if parameters is None else list(parameters.parameters) if isinstance(parameters, Circuit) else [float(x) for x in parameters]
        if len(values) != needed:
            raise ValueError(f"{len(values)} parameter values, {needed} needed")
        return values

    def _buckets(self, n: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // self.rows_per_bucket))

    def _rank(self, n: int) -> int:
        """Dimensions of a batch's span: as many as leave some 64 cosets per bucket if the space were dense."""
        return self.max_rank or min(16, max(6, int(math.log2(max(n, 1) / (64 * self._buckets(n)) + 1))))

    def _batch(self, rows: DataFrame, steps: list[Rotation], n: int) -> list[Rotation]:
        """The longest next batch that deals the rows evenly. Rotations of one kind (all bonds, all fields) leave a wide
        system many cosets, whatever they span; a dense small one has 2 ** (slots - rank) of them at most."""
        least = self._rank(n)
        ranks = [self.max_rank] if self.max_rank else [r for r in (64, 32) if r <= 2 * self._size - 9] + [least]
        for rank in ranks:
            part = batches(steps, rank)[0]
            if rank == ranks[-1]:
                break
            key = frozenset(r.g for r in part)  # Trotter steps repeat: a span is judged once
            if key not in self._even:
                self._even[key] = evenly(rows, self.algebra, part, self._buckets(n)) < 1.5
            if self._even[key]:
                break
        return part

    def _advance(self, rows: DataFrame, steps: list[Rotation], cut: Truncation, *, informed: bool = True, record: list | None = None) -> DataFrame:
        """rows after the steps: a small table in one task as far as it stays small, a large one batch by batch, each
        with one shuffle. record collects the written tables of edges and counts."""
        how = {"schrodinger": self.schrodinger, "occupied": self._occupied, "informed": informed}
        at, n, kept = 0, rows.count(), None
        while at < len(steps):
            last = kept
            if n <= self.local_rows:
                out = keep(evolve(rows, self.algebra, steps[at:], cut, **how, record=record is not None, buckets=1, limit=self.local_limit))
                done = out.where(F.col("kind") == DONE).agg(F.max("n")).first()[0]
                if done is None:  # no rows, nothing to rotate
                    break
                at += done
            elif record is not None:
                part = self._batch(rows, steps[at:], n)
                self.shuffles += 1
                out = keep(evolve(rows, self.algebra, part, cut, **how, record=True, buckets=self._buckets(n)))
                at += len(part)
            else:
                written = rows
                for _ in range(self.batches_per_write):
                    part = self._batch(written, steps[at:], n)
                    rows = evolve(rows, self.algebra, part, cut, **how, buckets=self._buckets(n))
                    at += len(part)
                    self.shuffles += 1
                    if at == len(steps):
                        break
                out = keep(rows.withColumn("kind", F.lit(ROW)))
            rows, kept = out.where(F.col("kind") == ROW).select(*self._names, "c", "layer"), out
            n = rows.count()
            if record is not None:
                record.append(out)
            else:
                discard(last)
        return rows

    def _touching(self, rows: DataFrame, steps: list[Rotation]) -> list[Rotation]:
        """The rotations that can find an anticommuting row. The slots in use come from one aggregate and grow by each
        rotation kept; a generator outside them (an odd Majorana one aside) commutes with every row."""
        used = B.join(rows.agg(*[F.expr(f"coalesce(bit_or({n}), 0L)") for n in self._names]).first())
        out = []
        for r in [r for r in steps if r.g]:
            odd = self.basis == "majorana" and r.g.bit_count() % 2
            if odd or used & (swapped(r.g) if self.basis == "pauli" else r.g):
                out.append(r)
                used |= r.g
        return out

    def propagate(self, circuit: Circuit, *, only_rotate_len_k: int | None = None) -> None:
        """Evolve the table at the circuit's own angles, without a graph. Heisenberg: last gate first."""
        if self._graph.layers:
            raise RuntimeError("propagate needs an empty graph; contract it first")
        cut = self._check(circuit, only_rotate_len_k)
        values = self._bind(circuit, circuit.n_parameters)
        flat = circuit.layers()
        steps = [Rotation(g, values[p] * c, i) for i, (g, c, p) in enumerate(zip(flat.masks, flat.coefficients, flat.mapping))]
        steps = steps if self.schrodinger else steps[::-1]
        steps = self._touching(self._rows, steps)
        if steps:
            self._rows = self._advance(self._rows, steps, cut).withColumn("layer", F.lit(-1))
        self._operator_epoch += 1

    def build_graph(self, circuit: Circuit, *, seed_parameters=None, only_rotate_len_k: int | None = None) -> None:
        """Append a circuit's layers, recording which pairs each rotates; later evaluation takes only parameters.

        With angles known (the circuit's own on the first call, else seed_parameters for the whole graph) truncation
        sees coefficients; otherwise it is structural.
        """
        cut = self._check(circuit, only_rotate_len_k)
        flat = circuit.layers(self._n_params)
        n_params = self._n_params + circuit.n_parameters
        seed = seed_parameters if seed_parameters is not None else circuit.parameters if not self._graph.layers and circuit.parameters else None
        values = None if seed is None else self._bind(seed, n_params)
        first_gate = self.n_gates
        layers = [Layer(0, g, c, p, first_gate + k) for g, c, p, k in zip(flat.masks, flat.coefficients, flat.mapping, flat.gates)]
        layers = layers if self.schrodinger else layers[::-1]
        for i, x in enumerate(layers):
            x.number = self._built + i
        rows = self._rows
        if values is not None and self._graph.layers:
            rows = self._folded(values)
        steps = [Rotation(x.g, values[x.parameter] * x.coefficient if values else 0.0, x.number) for x in layers]
        graph = replace(self._graph)
        found: list[DataFrame] = []
        rows = self._advance(rows, self._touching(rows, steps), cut, informed=values is not None, record=found)
        edges, alone = graph.edges, graph.cosine_only
        for out in found:
            new = out.where(F.col("kind") == EDGE).select(*self._names, "layer")
            edges = new if edges is None else edges.unionByName(new)
            new = out.where(F.col("kind") == COSINE).select("layer", "n")
            alone = new if alone is None else alone.unionByName(new)
        # the graph's table keeps the values of before the graph; new rows start at 0, or at their state phase
        old = self._rows.select(*self._names, F.col("c").alias("old"))
        fresh = f"coalesce({self.algebra.state_phase(self._names, self._occupied)}, 0D)" if self.schrodinger else "0D"
        grown = rows.join(old, self._names, "left").selectExpr(*self._names, f"coalesce(old, {fresh}) AS c", "layer")
        graph.layers = [*reversed(layers), *graph.layers] if self.schrodinger else [*graph.layers, *layers]
        if edges is not None:
            # in the order of the layers, so that a batch of a later replay reads the row groups of its own layers only
            parts = max(1, -(-sum(x.where(F.col("kind") == EDGE).count() for x in found) // self.rows_per_bucket))
            graph.edges = keep(edges.repartitionByRange(parts, "layer", *self._names).sortWithinPartitions("layer"), "edges")
            graph.cosine_only = keep(alone.groupBy("layer").agg(F.sum("n").alias("n")), "counts")
        self._rows, self._graph = keep(grown), graph
        discard(*found)
        self._built += len(layers)
        self._n_params = n_params
        self._graph_epoch += 1

    # --- evaluation

    def _steps(self, values: list[float], graph: Graph) -> list[Rotation]:
        return [Rotation(x.g, values[x.parameter] * x.coefficient, x.number) for x in graph.layers]

    def _operator_rows(self) -> DataFrame:
        """The operator's coefficients over the table's rows."""
        if not self.schrodinger:
            return self._rows
        op = self._operator.withColumnRenamed("c", "value")
        return self._rows.drop("c").join(op, self._names, "left").selectExpr(*self._names, "coalesce(value, 0D) AS c", "layer")

    def _sensitivity(self, rows: DataFrame) -> DataFrame:
        """Each row's weight in the expectation value: its state phase, or the state's coefficient."""
        if not self.schrodinger:
            phase = self.algebra.state_phase(self._names, self._occupied)
            return rows.withColumn("back", F.expr(f"coalesce({phase}, 0D)"))
        state = self._rows.select(*self._names, F.col("c").alias("back"))
        return rows.join(state, self._names)

    def _parts(self, n: int, steps: list[Rotation], swept: bool) -> tuple[list[list[Rotation]], int]:
        """Batches of a replay over n rows, and its buckets: one of each for a small table. A sweep back holds the values
        before each layer, so its batches are shorter the more rows there are."""
        if n <= self.local_limit:
            return batches(steps, None, max(1, 20_000_000 // max(n, 1)) if swept else 100_000), 1
        return batches(steps, self._rank(n), 40 if swept else 256), self._buckets(n)

    def _forward(self, rows: DataFrame, steps: list[Rotation], edges, cut: Truncation, marks: list | None = None) -> DataFrame:
        if edges is None:  # without a layer that touches a row: nothing
            return rows
        parts, buckets = self._parts(rows.count(), steps, marks is not None)
        last = None
        for i, part in enumerate(parts):
            if marks is not None:
                marks.append((part, rows))
            rows = replay(rows, edges, self.algebra, part, cut, buckets).select(*self._names, "c", "layer")
            if marks is not None or (i + 1) % self.batches_per_write == 0:
                rows = keep(rows)
                if marks is None:
                    discard(last)
                last = rows
        return rows

    def _folded(self, values: list[float]) -> DataFrame:
        """The table with the whole graph contracted into it: the operator after it, or the state after it."""
        steps = self._steps(values, self._graph)
        if not self.schrodinger:
            return self._forward(self._rows, steps, self._graph.edges, self._cut)
        if self._graph.edges is None:
            return self._rows
        rows = self._rows.withColumn("back", F.col("c")).withColumn("c", F.lit(0.0))
        parts, buckets = self._parts(rows.count(), steps, True)
        last = None
        for i, part in enumerate(reversed(parts)):
            out = replay_back(rows, self._graph.edges, self.algebra, part, self._cut, buckets)
            rows = out.where(F.col("kind") == ROW).selectExpr(*self._names, "0D AS c", "layer", "c AS back")
            if (i + 1) % self.batches_per_write == 0:
                rows = keep(rows)
                discard(last)
                last = rows
        rows = keep(rows.selectExpr(*self._names, "back AS c", "layer"))
        discard(last)
        return rows

    def expectation_value(self, parameters=None) -> float:
        return self._expectation(self._bind(parameters, self._n_params), self._graph, self._operator_rows(), self.core)

    def _expectation(self, values, graph: Graph, rows: DataFrame, core: float) -> float:
        rows = self._forward(rows, self._steps(values, graph), graph.edges, self._cut)
        return core + (self._sensitivity(rows).agg(F.sum(F.col("c") * F.col("back"))).first()[0] or 0.0)

    def expectation_value_and_gradient(self, parameters=None) -> tuple[float, np.ndarray]:
        return self._with_gradient(self._bind(parameters, self._n_params), self._graph, self._operator_rows(), self.core, self._n_params)

    def _with_gradient(self, values, graph: Graph, rows: DataFrame, core: float, n: int) -> tuple[float, np.ndarray]:
        """A forward sweep that keeps each batch's input, then the transposed sweep back over the batches."""
        marks: list = []
        rows = self._forward(rows, self._steps(values, graph), graph.edges, self._cut, marks)
        last = keep(self._sensitivity(rows))
        if marks:
            discard(rows)
        value = core + (last.agg(F.sum(F.col("c") * F.col("back"))).first()[0] or 0.0)
        slopes: dict[int, float] = {}
        back, kept = last.select(*self._names, "back"), last
        buckets = self._parts(last.count(), [], True)[1]
        for part, before in reversed(marks):
            both = before.join(back, self._names)
            out = keep(replay_back(both, graph.edges, self.algebra, part, self._cut, buckets))
            for r in out.where(F.col("kind") == EDGE).groupBy("layer").agg(F.sum("c").alias("s")).collect():  # a row per layer
                slopes[r["layer"]] = r["s"]
            back = out.where(F.col("kind") == ROW).select(*self._names, F.col("c").alias("back"))
            discard(kept)
            kept = out
        discard(kept, *[m for _, m in marks[1:]])  # the first mark is the propagator's own table
        gradient = np.zeros(n)
        for x in graph.layers:
            gradient[x.parameter] += slopes.get(x.number, 0.0) * x.coefficient
        return value, gradient

    def gradient(self, parameters=None) -> np.ndarray:
        return self.expectation_value_and_gradient(parameters)[1]

    def _pared(self, threshold: float | None) -> tuple[Graph, DataFrame]:
        """The rows that can reach the result: ends of rotated pairs, and paired rows. The others only scale by cosines
        and weigh nothing in the expectation value, so for a threshold below 1 nothing changes."""
        rows = self._operator_rows()
        if threshold is None or self._graph.edges is None:
            return self._graph, rows
        g_of = [(x.number, *B.split(x.g, self.algebra.words)) for x in self._graph.layers]
        gates = F.broadcast(local_frame(self.spark, g_of, "layer int, " + ", ".join(f"g{i} long" for i in range(self.algebra.words))))
        ends = self._graph.edges.join(gates, "layer")
        other = ends.selectExpr(*[f"({n} ^ g{i}) AS {n}" for i, n in enumerate(self._names)])
        reached = ends.select(*self._names).unionByName(other)
        weighs = self._sensitivity(rows).where(F.abs("back") > threshold).select(*self._names)
        return self._graph, keep(rows.join(reached.unionByName(weighs).distinct(), self._names, "left_semi"))

    def _functional(self, pare_threshold: float | None, evaluate):
        graph, rows = self._pared(pare_threshold)
        graph, core, n = copy.copy(graph), self.core, self._n_params
        made = (self._operator_epoch, self._graph_epoch)

        def call(parameters=None):
            if (self._operator_epoch, self._graph_epoch) != made:
                raise StaleFunctionalError("the propagator has changed since this functional was made")
            return evaluate(self._bind(parameters, n), graph, rows, core, n)

        return call

    def expectation_value_functional(self, pare_threshold: float | None = None):
        return self._functional(pare_threshold, lambda v, g, r, c, n: self._expectation(v, g, r, c))

    def expectation_value_and_gradient_functional(self, pare_threshold: float | None = None):
        return self._functional(pare_threshold, self._with_gradient)

    expval, grad, expval_and_grad = expectation_value, gradient, expectation_value_and_gradient
    expval_functional, expval_and_grad_functional = expectation_value_functional, expectation_value_and_gradient_functional

    def contract_partially(self, parameters=None, *, inplace: bool = True) -> DataFrame:
        """Fold the graph into the operator, or the state; the table with its terms (w0.., c)."""
        if not self._graph.layers:
            return self._rows.select(*self._names, "c")
        rows = keep(self._folded(self._bind(parameters, self._n_params)), "contracted")
        if inplace:
            self._rows = keep(rows.withColumn("layer", F.lit(-1)))
            self._graph, self._built, self._n_params = Graph(), 0, 0
            self._graph_epoch += 1
            self._operator_epoch += 1
        return rows.select(*self._names, "c")

    def evolved_frame(self, parameters=None, *, atol: float = 1e-12, digits: int | None = 12) -> DataFrame:
        """(w0.., c) of the evolved operator or state, values rounded to 12 digits; the sink for large results."""
        rows = self.contract_partially(parameters, inplace=False).where(F.abs("c") >= atol)
        if not self.schrodinger and self.core:
            core = local_frame(self.spark, [(*[0] * self.algebra.words, self.core)], rows.schema)
            rows = rows.unionByName(core)
        return rows if digits is None else rows.withColumn("c", F.round("c", digits))

    def _decoded(self, parameters, atol: float) -> dict[int, complex]:
        masks = ((B.join(r[:-1]), r[-1]) for r in self.evolved_frame(parameters, atol=atol).collect())
        return {m: self.algebra.decode(m, c) for m, c in masks}

    def update_initial_operator(self, new_operator) -> None:
        """Replace the operator's coefficients by those of an operator, or of a table (w0.., c); terms that are not given
        become 0, the core stays unless it is given.

        Heisenberg: a term that the table does not hold raises RuntimeError.
        """
        if isinstance(new_operator, DataFrame):
            core, new = self._split_frame(new_operator)
            given = core != 0.0
        else:
            masks, size = self._terms_of(new_operator)
            if size != self._size:
                raise ValueError(f"operator width {size}, propagator width {self._size}")
            core, new = self._split_core(masks)
            given = 0 in masks
        if not self.schrodinger:
            if not new.join(self._rows, self._names, "left_anti").isEmpty():
                raise RuntimeError("the new operator has a term that the current one does not hold")
            value = new.withColumnRenamed("c", "value")
            self._rows = keep(self._rows.drop("c").join(value, self._names, "left").selectExpr(*self._names, "coalesce(value, 0D) AS c", "layer"))
        self._operator = new
        if given:
            self.core = core
        self._operator_epoch += 1

    def replace_terms(self, terms: DataFrame) -> None:
        """Go on from another table (w0.., c) of this width; there must be no graph."""
        if self._graph.layers:
            raise RuntimeError("replace_terms needs an empty graph; contract it first")
        self._rows = keep(terms.select(*self._names, "c").withColumn("layer", F.lit(-1)))
        self._operator_epoch += 1

    def terms(self) -> DataFrame:
        """The table as it is, (w0.., c): the operator, or the state."""
        return self._rows.select(*self._names, "c")

    def pared_terms(self, threshold: float = 0.5) -> DataFrame:
        """The terms that a functional with this threshold keeps: those that can reach its result."""
        return self._pared(threshold)[1].select(*self._names, "c")

    def graph_edges(self, layers: int | None = None) -> DataFrame:
        """(w0.., layer): the lower end of each rotated pair, of the first layers only if a number is given."""
        schema = ", ".join(f"{n} long" for n in self._names) + ", layer int"
        edges = self._graph.edges if self._graph.edges is not None else local_frame(self.spark, [], schema)
        if layers is None:
            return edges
        return edges.where(F.col("layer").isin([x.number for x in self._graph.layers[:layers]]))

    def graph_counts(self) -> DataFrame:
        """(layer, cosine_only, cycles) of every layer that met a row which anticommutes or might have."""
        alone = self._graph.cosine_only if self._graph.cosine_only is not None else local_frame(self.spark, [], "layer int, n long")
        cycles = self.graph_edges().groupBy("layer").agg(F.count(F.lit(1)).alias("cycles"))
        return alone.select("layer", F.col("n").alias("cosine_only")).join(cycles, "layer", "left").fillna({"cycles": 0})

    def size(self) -> int:
        return self._rows.count()

    def graph_size(self) -> tuple[int, int]:
        """(cosine-only rows, rotated pairs), summed over the layers."""
        if self._graph.edges is None:
            return 0, 0
        return self._graph.cosine_only.agg(F.sum("n")).first()[0] or 0, self._graph.edges.count()

    def _per_slot(self, aggregate: str) -> DataFrame:
        columns = [F.expr(aggregate.format(f"shiftrightunsigned({self._names[s // 64]}, {s % 64}) & 1L")).alias(str(s)) for s in range(2 * self._size)]
        stack = ", ".join(f"{s}, `{s}`" for s in range(2 * self._size))
        return self._rows.agg(*columns).selectExpr(f"stack({2 * self._size}, {stack}) AS (slot, n)")

    def slot_counts(self) -> DataFrame:
        """(slot, n): how many terms hold each slot."""
        return self._per_slot("sum({})")

    def row_parity(self) -> DataFrame:
        """(slot, n): whether an odd number of terms holds each slot."""
        return self._per_slot("coalesce(bit_xor({}), 0L)")

    def memory(self) -> dict[str, int]:
        """Rows and bytes of the tables: terms and edges by their row width in memory, and what their files hold."""
        terms, edges = self.size(), self.graph_size()[1]
        width = 8 * self.algebra.words
        out = {"terms": terms, "term_bytes": terms * (width + 12), "edges": edges, "edge_bytes": edges * (width + 4)}
        for name, frame in (("term_file_bytes", self._rows), ("edge_file_bytes", self._graph.edges)):
            out[name] = 0 if frame is None else int(str(frame._jdf.queryExecution().analyzed().stats().sizeInBytes()))
        return out

    def report(self) -> str:
        """The propagator's size and settings as a few lines of Markdown."""
        held = self.memory()
        cut = f"{self.cutoff_type} <= {self.cutoff}, lower {self.lower_atol}, upper {self.upper_atol}"
        rows = [("modes", self._size), ("picture", "Schroedinger" if self.schrodinger else "Heisenberg"), ("truncation", cut), ("layers", self.graph_layers), ("parameters", self._n_params), *held.items()]
        return "| what | value |\n| --- | --- |\n" + "\n".join(f"| {k} | {v} |" for k, v in rows)

    def __deepcopy__(self, memo):
        """Tables are immutable: a copy shares them."""
        out = copy.copy(self)
        out._graph = Graph([copy.copy(x) for x in self._graph.layers], self._graph.edges, self._graph.cosine_only)
        return out


class MajoranaPropagator(Propagator):
    basis = "majorana"

    def evolved_operator(self, parameters=None, *, atol: float = 1e-12) -> MajoranaOperator:
        out = MajoranaOperator({}, self._size)
        out.terms = {B.slots_of(m): c for m, c in self._decoded(parameters, atol).items()}
        return out


class PauliPropagator(Propagator):
    """cutoff and schrodinger_cutoff count qubits."""

    basis = "pauli"

    def __init__(self, initial_operator, initial_state, *, cutoff: int, schrodinger_cutoff: int | None = None, lower_atol: float | None = None, upper_atol: float | None = None, **more):
        kind = self._cutoff_type(more.pop("cutoff_type", None))
        limit = None if schrodinger_cutoff is None else 2 * schrodinger_cutoff
        super().__init__(initial_operator, initial_state, cutoff=cutoff, schrodinger_cutoff=limit, cutoff_type=kind, lower_atol=lower_atol, upper_atol=upper_atol, **more)

    @classmethod
    def _cutoff_type(cls, given: str | None) -> str:
        if given not in (None, "support"):
            raise ValueError("the Pauli basis is truncated by support")
        return "support"

    def _terms_of(self, operator):
        if not isinstance(operator, PauliOperator):
            raise TypeError(f"a PauliOperator is needed, not {type(operator).__name__}")
        return operator.masks(), operator.num_qubits

    @property
    def cutoff_type(self) -> str:
        return "support"

    def evolved_operator(self, parameters=None, *, atol: float = 1e-12) -> PauliOperator:
        return PauliOperator({Pauli.from_mask(m): c.real for m, c in self._decoded(parameters, atol).items()}, self._size)
