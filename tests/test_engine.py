import itertools
import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import dense
from bitweave import Circuit, ExpGate, FermiOperator, FermiString, Majorana, MajoranaOperator, MajoranaPropagator, Pauli, PauliOperator, PauliPropagator, models
from bitweave.functions import bits as B
from bitweave.functions.algebra import Algebra, antihermitian_correction, is_antihermitian, occupied_mask
from bitweave.operators import jordan_wigner_basis_change
from bitweave.plans.batch import Rotation, Span, batches, evolve
from bitweave.plans.rotate import rotate
from bitweave.plans.truncation import Truncation

ANGLES = [0.3, -0.7, 0.4, 1.1]


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


def pauli_case():
    op = PauliOperator({"ZIZ": 0.7, "XYI": -0.3, "IZI": 0.2, "III": 0.5}, 3)
    gates = [PauliOperator({"XIX": 1.0}, 3), PauliOperator({"ZZI": 0.5, "IIZ": -0.3}, 3), PauliOperator({"YXI": 0.8}, 3), PauliOperator({"IIY": 1.0}, 3)]
    return PauliPropagator, op, Circuit([ExpGate(g) for g in gates], 3, ANGLES, [1]), {"cutoff": 3}, {"schrodinger_cutoff": 3}


def majorana_case():
    op = MajoranaOperator({(0, 1): 1j, (2, 3, 4, 5): 0.5, (0, 3): -0.2j, (): 0.1}, 3)
    gates = [MajoranaOperator({(1, 2): 1j}, 3), MajoranaOperator({(0, 2, 3, 5): 0.4}, 3), MajoranaOperator({(3, 4): 0.7j}, 3), MajoranaOperator({(0, 1, 2, 5): 1.0}, 3)]
    return MajoranaPropagator, op, Circuit([ExpGate(g) for g in gates], 3, ANGLES, [0, 2]), {"cutoff": 6}, {"schrodinger_cutoff": 6}


CASES = [pauli_case, majorana_case]


@pytest.mark.parametrize("basis", ["pauli", "majorana"])
def test_algebra_against_matrices(spark, basis):
    """All pairs of three modes: anticommutation, and the rotation's sign, as numpy and as SQL."""
    n, algebra = 3, Algebra(basis, 1)
    if basis == "pauli":
        mats = [dense.pauli_matrix(PauliOperator({Pauli.from_mask(m): 1.0}, n)) for m in range(64)]
    else:
        mats = [dense.majorana_matrix(MajoranaOperator({B.slots_of(m): 1j ** (math.comb(m.bit_count(), 2) % 4)}, n)) for m in range(64)]
    m = np.arange(64, dtype=np.uint64)[:, None]
    rows = spark.range(64).selectExpr("id AS w0")
    for g in (1, 6, 9, 21, 30, 63):
        anti = [bool(np.abs(mats[i] @ mats[g] + mats[g] @ mats[i]).max() < 1e-9) for i in range(64)]
        assert algebra.np_anticommutes(m, g).tolist() == anti
        # d/dt exp(-itG') M exp(itG') at 0, with the structural generator G' = +g (Pauli) or the authored sign (Majorana)
        sign = 1 if basis == "pauli" else -1
        phases = algebra.np_phase(m, g)
        for i in np.flatnonzero(anti):
            slope = -1j * (mats[g] @ mats[i] - mats[i] @ mats[g]) * sign
            assert np.abs(slope - 2 * phases[i] * mats[i ^ g]).max() < 1e-9
        got = rows.selectExpr("w0", f"{algebra.anticommutes(['w0'], g)} AS a", f"{algebra.phase(['w0'], g)} AS p").orderBy("w0").collect()
        assert [r.a for r in got] == anti
        assert [r.p for r in got if r.a] == [int(phases[r.w0]) for r in got if r.a]


@pytest.mark.parametrize("case", CASES)
def test_both_pictures_and_graphs(case):
    kind, op, circuit, heisenberg, schrodinger = case()
    occupied = circuit.initial_state
    want = dense.expectation(op, circuit, occupied)
    h = kind.from_circuit(circuit, op, **heisenberg)
    assert h.expectation_value() == pytest.approx(want, abs=1e-12)
    evolved = dense.matrix(h.evolved_operator())
    u = dense.unitary(circuit)
    assert np.abs(evolved - u.conj().T @ dense.matrix(op) @ u).max() < 1e-10
    for more in ({}, schrodinger):
        p = kind(op, occupied, **heisenberg, **more)
        p.build_graph(circuit)
        assert p.graph_size()[0] == 0 and p.graph_layers == len(circuit.layers().masks) and p.n_gates == 4
        assert p.parameter_mapping == circuit.layers().mapping
        other = [0.1, 0.9, -0.2, 0.5]
        assert p.expectation_value(other) == pytest.approx(dense.expectation(op, circuit, occupied, other), abs=1e-12)
        value, slope = p.expectation_value_and_gradient(other)
        assert value == pytest.approx(dense.expectation(op, circuit, occupied, other), abs=1e-12)
        for i in range(4):
            up, down = list(other), list(other)
            up[i], down[i] = up[i] + 1e-6, down[i] - 1e-6
            numeric = (dense.expectation(op, circuit, occupied, up) - dense.expectation(op, circuit, occupied, down)) / 2e-6
            assert slope[i] == pytest.approx(numeric, abs=1e-6)
        f, pared = p.expval_functional(), p.expval_and_grad_functional(0.5)
        assert f(other) == pytest.approx(value, abs=1e-12)
        assert pared(other)[0] == pytest.approx(value, abs=1e-12) and np.allclose(pared(other)[1], slope)
        p.contract_partially(circuit.parameters)
        assert p.n_parameters == 0 and p.expectation_value() == pytest.approx(want, abs=1e-12)
        with pytest.raises(RuntimeError):
            f(other)
    s = kind(op, occupied, **heisenberg, **schrodinger)
    s.propagate(circuit)
    assert s.expectation_value() == pytest.approx(want, abs=1e-12)


def test_jordan_wigner_isomorphism():
    _, op, circuit, _, _ = pauli_case()
    gates = [ExpGate(g.generator.get_majorana_operator()) for g in circuit.gates]
    assert np.abs(dense.majorana_matrix(op.get_majorana_operator()) - dense.pauli_matrix(op)).max() < 1e-12
    m = MajoranaPropagator.from_circuit(Circuit(gates, 3, ANGLES, [1]), op.get_majorana_operator(), cutoff=6)
    assert m.expectation_value() == pytest.approx(dense.expectation(op, circuit, [1]), abs=1e-12)
    assert jordan_wigner_basis_change(2) == [[0], [1], [0, 1, 2], [0, 1, 3]]


def test_closed_forms():
    p = MajoranaPropagator.from_circuit(Circuit([ExpGate(MajoranaOperator({(4, 5): 1j}, 8))], 8, [0.5], []), MajoranaOperator({(0, 1, 2, 4): 1}, 8), cutoff=8)
    terms = p.evolved_operator().terms
    assert set(terms) == {(0, 1, 2, 4), (0, 1, 2, 5)} and terms[0, 1, 2, 4] == pytest.approx(math.cos(1))
    p = PauliPropagator.from_circuit(Circuit([ExpGate(PauliOperator({"XI": 1.0}, 2))], 2, [0.5], []), PauliOperator({"ZZ": 1.0}, 2), cutoff=2)
    terms = p.evolved_operator().terms
    assert terms[Pauli("ZZ")] == pytest.approx(math.cos(1)) and terms[Pauli("YZ")] == pytest.approx(-math.sin(1))
    s = MajoranaPropagator(MajoranaOperator({}, 1), [], cutoff=2, schrodinger_cutoff=2)
    assert s.evolved_operator().terms == {(): 1, (0, 1): -1j}
    p = MajoranaPropagator(MajoranaOperator({(0, 1, 2, 4): 1}, 8), [], cutoff=8)
    assert p.contract_partially().collect()[0].c == -1.0
    s = MajoranaPropagator(MajoranaOperator({(0, 3): 1j}, 4), [], cutoff=8, schrodinger_cutoff=8)
    assert s.expectation_value() == 0.0
    s.update_initial_operator(MajoranaOperator({(0, 1): 2j}, 4))
    assert s.expectation_value() == -2.0


@pytest.mark.parametrize(("cutoff", "upper", "lower", "both"), [(4, None, None, True), (2, None, None, False), (2, 0.1, None, True), (2, 10.0, None, False), (4, None, 10.0, False)])
def test_truncation_grid(cutoff, upper, lower, both):
    upper = max(upper, lower) if upper is not None and lower is not None else upper
    circuit = Circuit.from_dense_arrays([(1, 2, 3, 4)], [1.0], [0], 5, [math.pi / 6], [])
    p = MajoranaPropagator.from_circuit(circuit, MajoranaOperator({(0, 1): 1j}, 5), cutoff=cutoff, upper_atol=upper, lower_atol=lower)
    terms = p.evolved_operator().terms
    assert terms[0, 1] == pytest.approx(0.5j) and ((0, 2, 3, 4) in terms) == both
    if both:
        assert abs(terms[0, 2, 3, 4]) == pytest.approx(math.sqrt(3) / 2)


def test_pair_rule_under_lower_atol():
    """One end passing its gate is enough for both to be rotated, exactly."""
    circuit = Circuit.from_dense_arrays([(1, 2)], [1.0], [0], 5, [1e-5], [])
    op = MajoranaOperator({(0, 1): 1j, (0, 2): 1e-7j}, 5)
    exact = MajoranaPropagator.from_circuit(circuit, op, cutoff=4).contract_partially().collect()
    for lower in (0.0, 1e-12, 1e-8):
        assert MajoranaPropagator.from_circuit(circuit, op, cutoff=4, lower_atol=lower).contract_partially().collect() == exact
    p = MajoranaPropagator(op, [], cutoff=4)
    p.build_graph(circuit)
    assert p.graph_size() == (0, 1) and p.size() == 2


def test_basis_change():
    circuit = Circuit.from_dense_arrays([(5,)], [-1.0], [0], 6, [1.0], [])
    p = MajoranaPropagator(MajoranaOperator({(0,): 1}, 6), [], cutoff=3)
    p.basis_change = jordan_wigner_basis_change(6)
    p.propagate(circuit)
    terms = p.evolved_operator().terms
    assert set(terms) == {(0,)} and terms[(0,)] == pytest.approx(math.cos(2))


@pytest.mark.parametrize("basis", ["pauli", "majorana"])
@pytest.mark.parametrize("words", [1, 2, 4])
@pytest.mark.parametrize("schrodinger", [False, True])
def test_batch_equals_single_pass(spark, basis, words, schrodinger):
    """The coset kernel, gate after gate in SQL, over words with slots on both sides of the word boundaries."""
    rng = np.random.default_rng(words)
    slots = 64 * words
    near = [s for s in range(slots) if slots <= 64 or s % 64 in (0, 1, 2, 3, 60, 61, 62, 63)]
    algebra = Algebra(basis, words)
    draw = lambda k: B.mask_of(rng.choice(near, k, replace=False).tolist())
    masks = {draw(int(rng.integers(1, 7))) for _ in range(200)}
    rows = spark.createDataFrame([(*B.split(m, words), float(rng.normal())) for m in sorted(masks)], ", ".join(f"{n} long" for n in B.word_names(words)) + ", c double")
    steps = [Rotation(draw(int(k)), float(rng.normal()), i) for i, k in enumerate(rng.integers(1, 5, 7))]
    cut = Truncation(8, "support", lower=0.02, upper=0.4, longest_source=9)
    occupied = occupied_mask((0, 2, 31))
    single = rows
    for r in steps:
        single = rotate(single, algebra, r.g, r.angle, cut, schrodinger, occupied)
    from pyspark.sql import functions as F

    whole = rows.withColumn("layer", F.lit(-1))
    parts = batches(steps, 3)
    assert len(parts) > 1
    for part in parts:
        whole = evolve(whole, algebra, part, cut, schrodinger=schrodinger, occupied=occupied)
    names = B.word_names(words)
    a = sorted(map(tuple, single.select(*names, "c").collect()))
    b = sorted(map(tuple, whole.select(*names, "c").collect()))
    assert [x[:-1] for x in a] == [x[:-1] for x in b] and np.allclose([x[-1] for x in a], [x[-1] for x in b], rtol=0, atol=1e-13)
    assert len(a) > 200


def test_colliding_hashes_are_told_apart(monkeypatch):
    """A salt under which monomials collide is given up for the next one."""
    from bitweave.plans import batch

    tables, salts = batch._hash_tables, []

    def weak(words, salt):
        salts.append(salt)
        return tables(words, salt) & np.uint64(3) if salt < 2 else tables(words, salt)

    monkeypatch.setattr(batch, "_hash_tables", weak)
    n, rng = 40, np.random.default_rng(1)
    masks = [int(x) << 50 for x in rng.integers(1, 1 << 20, 50)]
    m = np.stack([B.np_words(x, 2) for x in masks])

    def run(salt):
        h = batch.linear_hash(m, salt)
        if len(set(h.tolist())) < len(set(masks)):
            raise batch.Collision
        return salt

    assert batch._salted(run) == 2 and set(salts) == {0, 1, 2}
    a, b = (B.np_words(x, 2)[None, :] for x in masks[:2])
    assert (batch.linear_hash(a ^ b, 5) == batch.linear_hash(a, 5) ^ batch.linear_hash(b, 5)).all() and n == 40


@pytest.mark.parametrize("case", CASES)
def test_one_task_equals_many(case):
    """Small tables are rotated in one task; the same comes out of buckets, for tables, graphs and gradients."""
    kind, op, circuit, heisenberg, schrodinger = case()
    results = []
    for local_rows, local_limit in ((250_000, 1_000_000), (250_000, 2), (0, 0)):
        for more in ({}, schrodinger):
            p = kind(op, circuit.initial_state, **heisenberg, **more, max_rank=2)
            p.local_rows, p.local_limit = local_rows, local_limit
            q = kind(op, circuit.initial_state, **heisenberg, **more, max_rank=2)
            q.local_rows, q.local_limit = local_rows, local_limit
            p.propagate(circuit)
            q.build_graph(circuit)
            other = [0.1, 0.9, -0.2, 0.5]
            value, slope = q.expectation_value_and_gradient(other)
            results.append([p.expectation_value(), q.expectation_value(other), value, *slope, *q.graph_size()])
    for r in results[2:]:
        assert np.allclose(r, results[0], rtol=0, atol=1e-12) or np.allclose(r[:-2], results[0][:-2], rtol=0, atol=1e-12)


def test_setters_check_their_values():
    p = MajoranaPropagator(MajoranaOperator({(0, 1): 1j}, 4), [], cutoff=4, lower_atol=1e-8, upper_atol=1e-4)
    for name, good in (("lower_atol", [1e-10, None, 1e-4, 0]), ("upper_atol", [1e-3, None, 1.0]), ("cutoff", [0, 1000, np.int64(3)]), ("cutoff_type", ["support", "length"])):
        for value in good:
            setattr(p, name, value)
            assert getattr(p, name) == value
    p.lower_atol, p.upper_atol = 1e-8, 1e-4
    for name, value, error in (
        ("lower_atol", 1e-3, RuntimeError),
        ("upper_atol", 1e-9, ValueError),
        ("lower_atol", "x", TypeError),
        ("lower_atol", [1e-8], TypeError),
        ("lower_atol", -1.0, ValueError),
        ("lower_atol", float("nan"), ValueError),
        ("upper_atol", "x", TypeError),
        ("upper_atol", True, TypeError),
        ("cutoff", -1, ValueError),
        ("cutoff", 3.14, TypeError),
        ("cutoff", "x", TypeError),
        ("cutoff_type", "other", ValueError),
        ("cutoff_type", None, ValueError),
        ("predicate", "x", TypeError),
    ):
        before = getattr(p, name)
        with pytest.raises(error):
            setattr(p, name, value)
        assert getattr(p, name) == before


def test_predicate():
    """A rule of one's own: no partner may touch qubit 2."""
    from bitweave.plans.truncation import Predicate

    low = np.uint64(0b1111)
    away = Predicate(lambda w: f"({w[0]} & ~15L) = 0L", lambda m: (m[..., 0] & ~low) == 0)
    _, op, circuit, heisenberg, _ = pauli_case()
    small = PauliOperator({"XYI": -0.3, "IZI": 0.2}, 3)
    p = PauliPropagator(small, [1], cutoff=3, predicate=away)
    p.propagate(circuit)
    rows = p.spark.createDataFrame([(m, c) for m, c in small.masks().items()], "w0 long, c double")
    flat = circuit.layers()
    for g, c, k in reversed(list(zip(flat.masks, flat.coefficients, flat.mapping))):
        rows = rotate(rows, Algebra("pauli", 1), g, ANGLES[k] * c, Truncation(3, "support", predicate=away))
    a, b = ({r.w0: r.c for r in x.collect()} for x in (p.terms(), rows))
    assert a.keys() == b.keys() and all(m < 16 for m in a) and all(abs(a[m] - b[m]) < 1e-12 for m in a)


def test_from_frame():
    """A propagator that starts as a table: like terms merged, the identity kept apart, both pictures."""
    for case in CASES:
        kind, op, circuit, heisenberg, schrodinger = case()
        algebra = Algebra(kind.basis, 1)
        rows = [(m, algebra.encode(m, c) / 2) for m, c in op.masks().items()] * 2 if kind is PauliPropagator else [(m, algebra.encode(m, c) / 2) for m, c in op.masks().items()] * 2
        spark = kind(op, circuit.initial_state, **heisenberg).spark
        frame = spark.createDataFrame(rows, "w0 long, c double")
        want = dense.expectation(op, circuit, circuit.initial_state)
        for more in ({}, schrodinger):
            p = kind.from_frame(frame, 3, circuit.initial_state, **heisenberg, **more)
            p.propagate(circuit)
            assert p.expectation_value() == pytest.approx(want, abs=1e-12) and p.core == pytest.approx(op.masks()[0])
        assert kind.from_circuit(circuit, frame, **heisenberg).expectation_value() == pytest.approx(want, abs=1e-12)
        p = kind.from_frame(frame, 3, circuit.initial_state, **heisenberg)
        p.update_initial_operator(frame.withColumn("c", frame.c * 2))
        assert p.expectation_value() == pytest.approx(2 * kind(op, circuit.initial_state, **heisenberg).expectation_value())
    assert "| terms | " in p.report() and {"term_file_bytes", "edge_file_bytes"} <= set(p.memory())


def test_untouched_gates_are_skipped():
    n = 6
    op = PauliOperator({Pauli("Z", (0,)): 1.0}, n)
    circuit = Circuit([ExpGate(PauliOperator({Pauli("X", (q,)): 1.0}, n)) for q in range(n)], n, [0.1] * n)
    p = PauliPropagator(op, [], cutoff=n)
    flat = circuit.layers()
    steps = [Rotation(g, 0.1, i) for i, g in enumerate(flat.masks)]
    assert [r.layer for r in p._touching(p._rows, steps)] == [0]
    p.build_graph(circuit)
    assert p.graph_layers == n and p.graph_size() == (0, 1)
    assert p.expectation_value(circuit) == pytest.approx(math.cos(0.2))


def test_one_shuffle_per_gate_and_per_batch(spark):
    from bitweave.plans import catalogue

    start = spark.range(1000).selectExpr("id AS w0", "1D AS c")
    df = start
    for g, angle in catalogue.PAULI_GATES:
        df = rotate(df, Algebra("pauli", 1), g, angle, catalogue.OPEN)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == len(catalogue.PAULI_GATES) and plan.count("Range (") == 1
    plan = catalogue._evolved(start, "pauli", catalogue.PAULI_GATES, catalogue.OPEN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_system_and_bucket_counts(spark):
    """Seventy qubits (three words): any number of buckets gives the same result."""
    n = 70
    gates = [PauliOperator({Pauli("ZZ", (q, q + 1)): 0.5}, n) for q in (30, 31, 32, 62, 63)] + [PauliOperator({Pauli("X", (q,)): 1.0}, n) for q in (31, 32, 33, 63)]
    circuit = Circuit([ExpGate(g) for g in gates], n, np.linspace(0.1, 0.9, len(gates)), [32])
    op = PauliOperator({Pauli("Z", (32,)): 1.0, Pauli("YY", (63, 64)): 0.5}, n)
    got = []
    for rank in (1, 2, 6):
        p = PauliPropagator(op, [32], cutoff=5, max_rank=rank)
        p.local_rows = 0
        p.propagate(circuit)
        got.append(sorted(map(tuple, p.contract_partially().collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 4


def test_validation():
    op, n = PauliOperator({"ZZ": 1.0}, 2), 2
    gate = ExpGate(PauliOperator({"XI": 1.0}, 2))
    with pytest.raises(ValueError):
        PauliPropagator(op, [0, 0], cutoff=2)
    with pytest.raises(ValueError):
        PauliPropagator(op, [], cutoff=2, lower_atol=1.0, upper_atol=0.5)
    with pytest.raises(ValueError):
        MajoranaPropagator(MajoranaOperator({}, 0), [], cutoff=2)
    with pytest.raises(TypeError):
        Circuit([gate, ExpGate(MajoranaOperator({(0, 1): 1j}, 2))], 2)
    with pytest.raises(TypeError):
        ExpGate(Majorana(0, 1))
    with pytest.raises(TypeError):
        PauliOperator({}, True)
    with pytest.raises(ValueError):
        ExpGate(PauliOperator({"XI": 1.0, "ZI": 1.0}, 2))
    with pytest.raises(ValueError):
        ExpGate(MajoranaOperator({(0, 1): 1.0}, 2)).layers()
    with pytest.raises(ValueError):
        PauliOperator({"XX": 1j}, 2)
    with pytest.raises(ValueError):
        Circuit([ExpGate(gate.generator, 0), ExpGate(gate.generator, 2)], 2)
    with pytest.raises(ValueError):
        Circuit([ExpGate(gate.generator, 0), gate], 2)
    with pytest.raises(ValueError):
        Circuit([gate], 2, [0.1, 0.2])
    p = PauliPropagator(op, [], cutoff=2)
    with pytest.raises(ValueError):
        p.build_graph(Circuit([gate], 2, [0.1], [1]))
    with pytest.raises(ValueError):
        p.propagate(Circuit([ExpGate(PauliOperator({"XII": 1.0}, 3))], 3, [0.1]))
    with pytest.raises(ValueError):
        p.propagate(Circuit([gate], n, [0.1]), only_rotate_len_k=5)
    with pytest.raises(ValueError):
        p.basis_change = [[0]]
    with pytest.raises(ValueError):
        PauliPropagator(op, [], cutoff=2, cutoff_type="length")
    p.build_graph(Circuit([gate], 2, [0.1]))
    with pytest.raises(RuntimeError):
        p.propagate(Circuit([gate], 2, [0.1]))
    with pytest.raises(ValueError):
        p.expectation_value([])
    with pytest.raises(RuntimeError):
        p.update_initial_operator(PauliOperator({"XX": 1.0}, 2))


def test_graph_extension_rewiring_and_copy():
    import copy

    kind, op, circuit, heisenberg, _ = majorana_case()
    p = kind(op, circuit.initial_state, **heisenberg)
    p.build_graph(circuit)
    p.build_graph(circuit, seed_parameters=[*ANGLES, *ANGLES])
    assert p.n_parameters == 8 and p.n_gates == 8 and p.graph_layers == 8
    # the second call's gates act first on the operator's side after the first call's: U = U1 then U2 reversed per call
    u = dense.unitary(circuit)
    o = u.conj().T @ (u.conj().T @ dense.matrix(op) @ u) @ u
    b = dense.state(circuit.initial_state, 3)
    assert p.expectation_value([*ANGLES, *ANGLES]) == pytest.approx((b @ o @ b).real, abs=1e-12)
    twin = copy.deepcopy(p)
    p.parameter_mapping = [0, 1, 2, 3, 0, 1, 2, 3]
    assert p.n_parameters == 4 and twin.n_parameters == 8
    assert p.expectation_value(ANGLES) == pytest.approx(twin.expectation_value([*ANGLES, *ANGLES]), abs=1e-12)
    assert p.memory()["terms"] == p.size()
    assert sum(r.n for r in p.slot_counts().collect()) > 0


def test_update_initial_operator_keeps_the_core():
    p = MajoranaPropagator(MajoranaOperator({(): 0.5, (0, 1): 1j, (2, 3): 1j}, 2), [], cutoff=4)
    p.update_initial_operator(MajoranaOperator({(0, 1): 2j}, 2))
    assert p.expectation_value() == pytest.approx(0.5 - 2.0) and p.size() == 2
    p.update_initial_operator(MajoranaOperator({(): 1.0}, 2))
    assert p.expectation_value() == 1.0


def test_authoring_types():
    assert Majorana.from_unsorted(2, 0, 1) == (Majorana(0, 1, 2), 1.0)
    assert MajoranaOperator({(1, 0): 1, (0, 1): 1}, 1).terms == {(0, 1): 0}
    assert MajoranaOperator.from_lists([(0, 1), (0, 1)], [1, 2], 1).terms == {(0, 1): 3}
    with pytest.raises(ValueError):
        MajoranaOperator({(9, 0): 1}, 2)
    assert Pauli("IXZ") == Pauli("ZX", (2, 1))
    number = FermiOperator.from_dict({((0, "+"), (0, "-")): 1.0}, 1)
    assert number.get_majorana_operator().isclose(MajoranaOperator({(): 0.5, (0, 1): 0.5j}, 1))
    raised = dense.majorana_matrix(FermiOperator.from_dict({((0, "+"),): 1.0}, 1).get_majorana_operator())
    assert np.allclose(raised @ [1, 0], [0, 1])
    assert FermiString(((1, "-"), (0, "+"))).canonical() == (((0, "+"), (1, "-")), -1)
    assert FermiOperator.from_dict({((1, "-"), (0, "+")): 1.0}, 2).isclose(FermiOperator.from_dict({((0, "+"), (1, "-")): -1.0}, 2))
    assert is_antihermitian((0, 1)) and antihermitian_correction((0, 1)) == 1 and antihermitian_correction((0,)) == 1j
    assert PauliOperator({"XI": 1.0, "IX": 1.0}, 2).all_pairwise_commute() and not PauliOperator({"XI": 1.0, "ZI": 1.0}, 2).all_pairwise_commute()
    a = Circuit([ExpGate(PauliOperator({"X": 1.0}, 1))], 1, [0.1], [0])
    assert (a + a).resolved_mapping == (0, 1) and (a + a).parameters == (0.1, 0.1) and (a + a).initial_state == (0,)
    assert len(Circuit([ExpGate(PauliOperator({"X": 1e-9}, 1)), ExpGate(PauliOperator({"X": 1.0}, 1))], 1, [0.1, 0.2])) == 1
    flat = Circuit([ExpGate(PauliOperator({"X": 1e-9}, 1), 0)], 1).layers()
    assert (flat.masks, flat.coefficients) == ([0], [0.0])


def test_integrals():
    """A random restricted Hamiltonian is Hermitian and conserves the particle number."""
    from bitweave import integrals_to_fermion

    rng = np.random.default_rng(3)
    n = 2
    one = rng.normal(size=(n, n))
    one = one + one.T
    two = rng.normal(size=(n,) * 4)
    two = sum(two.transpose(p) for p in ((0, 1, 2, 3), (1, 0, 2, 3), (0, 1, 3, 2), (1, 0, 3, 2)))
    two = two + two.transpose(2, 3, 0, 1)
    op = integrals_to_fermion(0.7, np.array([one, one]), np.array([two, two, 0.5 * (two + two.transpose(2, 3, 0, 1))]))
    h = dense.majorana_matrix(op.get_majorana_operator())
    number = dense.majorana_matrix(FermiOperator.from_dict({((m, "+"), (m, "-")): 1.0 for m in range(2 * n)}, 2 * n).get_majorana_operator())
    assert np.abs(h - h.conj().T).max() < 1e-9 and np.abs(h @ number - number @ h).max() < 1e-9


def test_twelve_qubits_end_to_end(spark, tmp_path):
    """A Hamiltonian of 300 strings from a file and evolutions on pairs of qubits, against the state vector."""
    import json

    from bitweave.sources.files import circuit_from_gate_list, read_pauli_json

    n, rng = 12, np.random.default_rng(11)
    strings = {"".join(rng.choice(list("IIIXYZ"), n)): round(float(rng.normal()), 6) for _ in range(300)}
    (tmp_path / "h.json").write_text(json.dumps(strings))
    hamiltonian = read_pauli_json(spark, f"{tmp_path}/h.json")
    pairs = [{"II": 1.0, "XZ": 1.0}, {"IZ": 0.1, "ZZ": 0.1}, {"YI": 0.7, "IY": 0.1}, {"ZI": 0.5, "ZZ": 0.6}, {"YI": 0.7, "IY": 0.1}, {"XX": 0.4}]
    gates = [(("evolution", PauliOperator(op, 2)), (2 * i, 2 * i + 1), t) for i, (op, t) in enumerate(zip(pairs, (0.2, 0.1, 0.3, 0.1, 0.3, -0.7)))]
    gates += [(("evolution", PauliOperator({"ZY": 0.3}, 2)), (q + 1, q), 0.5) for q in range(0, 11, 3)]
    occupied = list(range(1, n, 2))
    p = PauliPropagator.from_circuit(circuit_from_gate_list(gates, n, occupied), hamiltonian, cutoff=n)
    psi = dense.state(occupied, n).astype(complex).reshape([2] * n)
    for (_, op), (a, b), t in gates:  # exp(-i t H) on two axes of the state
        w, v = np.linalg.eigh(dense.pauli_matrix(op))
        u = (v @ np.diag(np.exp(-1j * t * w)) @ v.conj().T).reshape(2, 2, 2, 2)
        psi = np.moveaxis(np.tensordot(u, psi, ((2, 3), (a, b))), (0, 1), (a, b))
    want = 0.0
    for letters, c in strings.items():
        turned = psi
        for q, letter in enumerate(letters):
            turned = np.moveaxis(np.tensordot(dense.ONE[letter], turned, (1, q)), 0, q)
        want += c * np.vdot(psi, turned).real
    assert p.expectation_value() == pytest.approx(want, abs=1e-9) and p.size() > 300


def test_models():
    bonds = models.heavy_hex_bonds()
    assert len(bonds) == 144 and max(map(max, bonds)) == 126 and max(sum(q in b for b in bonds) for q in range(127)) == 3
    assert {(109, 114), (33, 39), (71, 77)} <= {tuple(sorted(b)) for b in bonds}
    op, circuit = models.tilted_ising(2, 2, 1)
    assert PauliPropagator.from_circuit(circuit, op, cutoff=4).expectation_value() == pytest.approx(dense.expectation(op, circuit, ()), abs=1e-12)
    op, circuit = models.hubbard_chain(2, 1)
    p = MajoranaPropagator.from_circuit(circuit, op, cutoff=8)
    assert p.expectation_value() == pytest.approx(dense.expectation(op.get_majorana_operator(), circuit, circuit.initial_state), abs=1e-12)
    op, circuit = models.random_majorana(4, 10, 5, 4, seed=0)
    assert MajoranaPropagator.from_circuit(circuit, op, cutoff=8).expectation_value() == pytest.approx(dense.expectation(op, circuit, ()), abs=1e-12)  # of weight 4, structural and authored are equal
    assert len(models.kicked_ising(1)[1]) == 127 + 144


def test_span():
    gens = [0b0110, 0b0011, 0b0101, 0b1000]
    span = Span.of(gens)
    assert len(span.vectors) == 3
    assert all(span.reduce(m) == span.reduce(m ^ g) for m, g in itertools.product(range(16), gens))
