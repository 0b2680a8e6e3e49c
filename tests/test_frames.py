"""Authoring on tables against the same with Python objects."""

import numpy as np
import pytest

from bitweave import Circuit, ExpGate, FermiOperator, FermiString, MajoranaOperator, Pauli, PauliOperator, integrals_to_fermion
from bitweave.functions import bits as B
from bitweave.functions.algebra import Algebra
from bitweave.operators import frames
from bitweave.sources import adapter


def table(spark, operator):
    return spark.createDataFrame([(list(k), complex(v).real, complex(v).imag) for k, v in operator.items()], "idx array<int>, re double, im double")


def as_terms(rows):
    return {tuple(r.idx): complex(r.re, r.im) for r in rows.collect() if abs(complex(r.re, r.im)) > 1e-12}


def close(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_products(spark):
    rng = np.random.default_rng(0)
    keys = [tuple(rng.integers(0, 8, rng.integers(0, 6)).tolist()) for _ in range(60)]
    values = rng.normal(size=60) + 1j * rng.normal(size=60)
    rows = spark.createDataFrame([(list(k), float(v.real), float(v.imag)) for k, v in zip(keys, values)], "idx array<int>, re double, im double")
    want = MajoranaOperator.from_lists(keys, values, 4)
    assert close(as_terms(frames.normal_ordered(rows)), {k: v for k, v in want.terms.items() if abs(v) > 1e-12})


@pytest.mark.parametrize("basis", ["majorana", "pauli"])
@pytest.mark.parametrize("modes", [4, 70])
def test_encoding(spark, basis, modes):
    rng, algebra = np.random.default_rng(1), Algebra(basis, B.word_count(modes))
    masks = {B.mask_of(rng.choice(2 * modes, rng.integers(0, 6), replace=False).tolist()): float(rng.normal()) for _ in range(40)}
    authored = {B.slots_of(m): algebra.decode(m, c) for m, c in masks.items()}
    rows = frames.encoded(table(spark, authored), modes, basis)
    assert {B.join(r[:-1]): r[-1] for r in rows.collect()} == pytest.approx(masks)
    assert close(as_terms(frames.decoded(rows, modes, basis)), authored)
    with pytest.raises(Exception, match="not Hermitian"):
        frames.encoded(table(spark, {(0, 1): 1 + 1j}), modes, basis).collect()
    with pytest.raises(Exception, match="out of range"):
        frames.encoded(table(spark, {(2 * modes,): 1}), modes, basis).collect()


def ladders(spark, terms):
    return spark.createDataFrame([([m for m, _ in k], [s == "+" for _, s in k], float(v)) for k, v in terms.items()], "modes array<int>, raising array<boolean>, c double")


def test_ladders(spark):
    terms = {(): 0.5, ((0, "+"), (1, "-")): 1.0, ((1, "-"), (0, "+")): 0.25, ((2, "+"), (2, "-")): -1.5, ((2, "-"), (0, "-"), (1, "+"), (3, "+")): 0.75}
    want = FermiOperator.from_dict(terms, 4)
    got = as_terms(frames.majoranas_of_ladders(ladders(spark, terms)))
    assert close(got, {k: v for k, v in want.get_majorana_operator().terms.items() if abs(v) > 1e-12})
    canonical = {}
    for k, v in terms.items():
        key, sign = FermiString(k).canonical()
        canonical[key] = canonical.get(key, 0) + sign * v
    rows = frames.canonical_ladders(ladders(spark, terms)).collect()
    assert {tuple(zip(r.modes, ["-+"[u] for u in r.raising])): r.c for r in rows} == canonical


def test_integrals_on_tables(spark):
    rng, n = np.random.default_rng(2), 3
    h1, h2 = rng.normal(size=(2, n, n)), rng.normal(size=(3, n, n, n, n))
    h2[rng.random(h2.shape) < 0.5] = 0
    one = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(h1)], "spin int, p int, q int, value double")
    two = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(h2)], "block int, p int, q int, r int, t int, value double")
    want = integrals_to_fermion(0.7, h1, h2)
    got = frames.integral_ladders(one, two, n, 0.7).collect()
    assert close({tuple(zip(r.modes, ["-+"[u] for u in r.raising])): r.c for r in got}, {t.expression: c for t, c in zip(want.terms, want.coefficients)})
    # against the sum over all products, one by one
    plain = {(): 0.7}
    for (s, p, q), v in np.ndenumerate(h1):
        plain[(p + s * n, "+"), (q + s * n, "-")] = v
    full = FermiOperator.from_dict(plain, 2 * n).get_majorana_operator()
    for (block, p, q, r, t), v in np.ndenumerate(h2):
        a, b = ((0, 0), (0, n), (n, n))[block]
        term = FermiOperator([[(p + a, "+"), (r + b, "+"), (t + b, "-"), (q + a, "-")]], [v * (1 if block == 1 else 0.5)], 2 * n).get_majorana_operator()
        for k, x in term.terms.items():
            full.terms[k] = full.terms.get(k, 0) + x
    assert want.get_majorana_operator().isclose(full)


@pytest.mark.parametrize("qubits", [3, 40])
def test_jordan_wigner(spark, qubits):
    rng, words = np.random.default_rng(3), B.word_count(qubits)
    masks = range(64) if qubits == 3 else [B.mask_of(rng.choice(2 * qubits, rng.integers(0, 9), replace=False).tolist()) for _ in range(80)]
    algebra = Algebra("majorana", words)
    want = {}
    for m in masks:
        ((key, c),) = PauliOperator({Pauli.from_mask(m): 1.0}, qubits).get_majorana_operator().terms.items()
        want[m] = (B.mask_of(key), algebra.encode(B.mask_of(key), c))
    rows = spark.createDataFrame([(*B.split(m, words), 1.0 + i) for i, m in enumerate(masks)], ", ".join(f"{n} long" for n in B.word_names(words)) + ", c double")
    got = {round(abs(r.c)) - 1: (B.join(r[:-1]), np.sign(r.c)) for r in frames.jordan_wigner_rows(rows, qubits).collect()}
    assert got == {i: want[m] for i, m in enumerate(masks)}


@pytest.mark.parametrize("qubits", [3, 40])
def test_labels(spark, qubits):
    rng = np.random.default_rng(4)
    labels = ["".join(rng.choice(list("IXYZ"), qubits)) for _ in range(30)]
    rows = frames.pauli_words(spark.createDataFrame([(x,) for x in labels], "label string"), qubits)
    assert {r.label: B.join(r[1:]) for r in rows.collect()} == {x: Pauli(x).mask for x in labels}
    back = frames.pauli_labels(rows.withColumnRenamed("label", "old"), qubits, reverse=True)
    assert all(r.label == r.old[::-1] for r in back.collect())
    with pytest.raises(Exception, match="Pauli string"):
        frames.pauli_words(spark.createDataFrame([("XQ",)], "label string"), 2).collect()


def test_rotations_and_commuting(spark):
    from bitweave.sources.files import circuit_from_gate_list

    gates = [("rx", [1], 0.3), ("rzz", [0, 2], -0.4), ("barrier", [0], 0.0), ("rxy", [2, 1], 0.5)]
    rows = frames.rotations_of(spark.createDataFrame(gates, "name string, qubits array<int>, value double")).collect()
    flat = circuit_from_gate_list(gates, 3).layers()
    assert [(B.mask_of(r.idx), r.gcoef) for r in rows] == list(zip(flat.masks, flat.coefficients)) and [r.angle for r in rows] == [0.3, -0.4, 0.5]
    with pytest.raises(Exception, match="unsupported gate"):
        frames.rotations_of(spark.createDataFrame([("cx", [0, 1], 0.0)], "name string, qubits array<int>, value double")).collect()
    for basis, kind in (("pauli", lambda m: PauliOperator({Pauli.from_mask(x): 1.0 for x in m}, 3)), ("majorana", lambda m: MajoranaOperator({B.slots_of(x): 1.0 for x in m}, 3))):
        rng = np.random.default_rng(5)
        sets = [rng.integers(1, 64, 2).tolist() for _ in range(40)]
        rows = spark.createDataFrame([(i, m) for i, s in enumerate(sets) for m in s], "gate int, w0 long")
        assert {r.gate: r.commute for r in frames.products_commute(rows, 1, basis).collect()} == {i: kind(s).all_pairwise_commute() for i, s in enumerate(sets)}


def test_is_close(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1e-9)], "w0 long, c double")
    b = spark.createDataFrame([(1, 1.0 + 1e-7), (3, 1e-3)], "w0 long, c double")
    assert frames.is_close(a, b, 1).first().asDict() == {"terms": 3, "close": 2, "equal": False}
    assert frames.is_close(a.limit(0), b.limit(0), 1).first().asDict() == {"terms": 0, "close": 0, "equal": True}


class Labels(list):
    def to_labels(self):
        return list(self)


class Sum:
    """What the adapter uses of an external sparse Pauli sum."""

    def __init__(self, labels, coeffs):
        self.paulis, self.coeffs, self.num_qubits = Labels(labels), np.array(coeffs, complex), len(labels[0])

    def simplify(self, atol):
        kept = [(x, c) for x, c in zip(self.paulis, self.coeffs) if abs(c) > atol]
        return Sum([x for x, _ in kept], [c for _, c in kept])


class Gate:
    def __init__(self, name, params=(), operator=None, time=None):
        self.name, self.params, self.operator, self.time = name, list(params), operator, time


class Item:
    def __init__(self, operation, qubits):
        self.operation, self.qubits = operation, qubits


class External:
    """What the adapter uses of an external circuit: registers and instructions."""

    def __init__(self, n, *items, registers=1):
        self.bits = [object() for _ in range(n)]
        self.qregs = [self.bits] * registers
        self.data = [Item(g, [self.bits[q] for q in qubits]) for g, qubits in items]


def test_adapter_import():
    op = adapter.from_qiskit_operator(Sum(["XZ", "IY", "ZZ"], [1.0, 0.5, 1e-12]))
    assert op == PauliOperator({"ZX": 1.0, "YI": 0.5}, 2)
    circuit = adapter.from_qiskit_circuit(External(3, (Gate("rx", [0.5]), [0]), (Gate("barrier"), [0, 1, 2]), (Gate("rzz", [0.2]), [1, 2]), (Gate("PauliEvolution", operator=Sum(["XZ"], [0.7]), time=0.3), [2, 0])), [1])
    assert [g.generator for g in circuit] == [PauliOperator({Pauli("X", (0,)): -0.5}, 3), PauliOperator({Pauli("ZZ", (1, 2)): -0.5}, 3), PauliOperator({Pauli("ZX", (2, 0)): -0.7}, 3)]
    assert circuit.parameters == (0.5, 0.2, 0.3) and circuit.initial_state == (1,)
    with pytest.raises(ValueError, match="Unsupported gate"):
        adapter.from_qiskit_circuit(External(1, (Gate("h"), [0])), [])
    with pytest.raises(ValueError, match="register"):
        adapter.from_qiskit_circuit(External(1, registers=2), [])


def test_adapter_export(monkeypatch):
    import sys
    import types

    made = []

    class QuantumCircuit:
        def __init__(self, n):
            self.n = n
            made.append(self)
            self.items = []

        def append(self, gate, qubits):
            self.items.append((gate, qubits))

    class SparsePauliOp:
        @staticmethod
        def from_sparse_list(terms, num_qubits):
            labels = []
            for letters, qubits, _ in terms:
                label = ["I"] * num_qubits
                for letter, q in zip(letters, qubits):
                    label[num_qubits - 1 - q] = letter
                labels.append("".join(label))
            return Sum(labels, [c for *_, c in terms])

    modules = {
        "qiskit": types.ModuleType("qiskit"),
        "qiskit.circuit": types.SimpleNamespace(QuantumCircuit=QuantumCircuit),
        "qiskit.circuit.library": types.SimpleNamespace(PauliEvolutionGate=lambda op, time: Gate("PauliEvolution", operator=op, time=time)),
        "qiskit.quantum_info": types.SimpleNamespace(SparsePauliOp=SparsePauliOp),
    }
    for name, module in modules.items():
        monkeypatch.setitem(sys.modules, name, module)
    circuit = Circuit([ExpGate(PauliOperator({Pauli("XYZ", (3, 1, 2)): 1.0}, 4)), ExpGate(PauliOperator({Pauli("Z", (0,)): 0.5}, 4))], 4, [-1.2, 0.4], [])
    out = adapter.to_qiskit_circuit(circuit, 4)
    assert made == [out] and out.n == 4 and [q for _, q in out.items] == [[1, 2, 3], [0]]
    back = adapter.from_qiskit_circuit(External(4, *out.items), [])
    assert back == circuit
    with pytest.raises(ValueError, match=r"num_qubits=3 does not match circuit.system_size=4"):
        adapter.to_qiskit_circuit(circuit, 3)
    with pytest.raises(ValueError, match="bound circuit"):
        adapter.to_qiskit_circuit(Circuit([ExpGate(PauliOperator({"X": 1.0}, 1))], 1), 1)
    with pytest.raises(TypeError, match="majorana-family gate"):
        adapter.to_qiskit_circuit(Circuit([ExpGate(MajoranaOperator({(0, 1): 1j}, 1))], 1, [0.5]), 1)
