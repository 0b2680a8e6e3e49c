import json
import math

import numpy as np
import pytest

from bitweave import Circuit, ExpGate, MajoranaOperator, MajoranaPropagator, Pauli, PauliOperator, PauliPropagator
from bitweave.sources import read_circuit, read_operator, read_problem, write_circuit, write_operator, write_problem
from bitweave.sources.files import circuit_from_gate_list, gate_list_from_circuit, read_fcidump, read_fermi_json, read_pauli_json
from bitweave.sources.tables import Problem, gate_sessions, slots_of_words, words_of


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    op = MajoranaOperator({(0, 1): 1j, (2, 3, 4, 5): 0.5, (): 2}, 3)
    write_operator(spark, op, f"{tmp_path}/op", fmt)
    assert read_operator(spark, f"{tmp_path}/op", 3, fmt) == op
    circuit = Circuit([ExpGate(MajoranaOperator({(1, 2): 1j}, 3)), ExpGate(MajoranaOperator({(0, 2, 3, 5): 0.4, (1, 4): 1j}, 3))], 3, [0.1, 0.2], [1])
    write_circuit(spark, circuit, f"{tmp_path}/gates", fmt)
    back = read_circuit(spark, f"{tmp_path}/gates", 3, fmt, circuit.parameters, [1])
    a, b = circuit.layers(), back.layers()
    assert a.masks == b.masks and a.mapping == b.mapping and a.gates == b.gates and np.allclose(a.coefficients, b.coefficients)
    pauli = PauliOperator({"XZ": 0.5, "IY": 1.0}, 2)
    write_operator(spark, pauli, f"{tmp_path}/pauli", fmt)
    assert read_operator(spark, f"{tmp_path}/pauli", 2, fmt, "pauli") == pauli


def test_problem(spark, tmp_path):
    circuit = Circuit.from_dense_arrays([(1, 2), (0, 3), (0, 1)], [1.0, 0.5, 0.2], [0, 0, 1], 2, [0.3, 0.4], [0])
    assert len(circuit) == 2
    write_problem(spark, Problem(MajoranaOperator({(0, 1): 1j}, 2), circuit, -0.5, [0.1, 0.2]), f"{tmp_path}/p")
    back = read_problem(spark, f"{tmp_path}/p")
    assert back.circuit == circuit and back.energy == -0.5 and back.gradient == [0.1, 0.2]


def test_words(spark):
    terms = spark.createDataFrame([([0, 65, 127], 1.0), ([127, 0, 65], 2.0), ([63], 1.0)], "idx array<int>, c double")
    rows = words_of(terms, 64)
    got = {tuple(r.idx): r.c for r in slots_of_words(rows, 64).collect()}
    assert got == {(0, 65, 127): 3.0, (63,): 1.0}
    with pytest.raises(Exception, match="out of range"):
        words_of(terms, 20).collect()


def test_gate_sessions(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 0)], "layer int, param int")
    assert [r.gate for r in gate_sessions(rows).orderBy("layer").collect()] == [0, 0, 1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "op.json").write_text(json.dumps({"XIZ": 0.5, "IYI": -1.0}))
    assert read_pauli_json(spark, f"{tmp_path}/op.json") == PauliOperator({"XIZ": 0.5, "IYI": -1.0}, 3)
    (tmp_path / "f.json").write_text(json.dumps({"((0, 1), (1, 0))": 0.5, "()": 1.0}))
    assert len(read_fermi_json(spark, f"{tmp_path}/f.json", 2)) == 2
    (tmp_path / "dump").write_text(" &FCI NORB=  2,NELEC=2,MS2=0,\n &END\n 0.5 1 1 1 1\n 0.25 2 1 2 1\n -1.5 1 1 0 0\n 0.1 2 1 0 0\n 0.7 0 0 0 0\n")
    h0, h1, h2 = read_fcidump(spark, f"{tmp_path}/dump")
    assert h0 == 0.7 and h1[0, 0, 1] == h1[1, 1, 0] == 0.1 and h2[0, 0, 1, 1, 0] == 0.25 and h2[0, 0, 0, 0, 0] == 0.5


def test_gate_list(spark):
    """Rotations exp(-i t/2 P) against the closed form of one qubit."""
    for name, op, want in (("rx", "Z", math.cos(0.4)), ("ry", "X", math.sin(0.4)), ("rx", "Y", -math.sin(0.4))):
        circuit = circuit_from_gate_list([(name, (0,), 0.4), ("barrier", (0,), 0.0)], 1, [])
        assert PauliPropagator.from_circuit(circuit, PauliOperator({op: 1.0}, 1), cutoff=1).expectation_value() == pytest.approx(want)
    circuit = circuit_from_gate_list([(("evolution", PauliOperator({"ZX": 0.5}, 2)), (2, 0), 0.3), ("rzz", (1, 2), 0.2)], 3)
    assert circuit.gates[0].generator == PauliOperator({Pauli("XZ", (0, 2)): -0.5}, 3)
    assert circuit_from_gate_list(gate_list_from_circuit(circuit), 3) == circuit
    with pytest.raises(ValueError):
        circuit_from_gate_list([("cx", (0, 1), 0.0)], 2)


def stream_of(spark, path):
    return spark.readStream.schema("layer int, idx array<int>, gcoef double, angle double").parquet(path)


def add_gates(spark, path, *gates):
    spark.createDataFrame(list(gates), "layer int, idx array<int>, gcoef double, angle double").coalesce(1).write.mode("append").parquet(path)


def test_stream(spark, tmp_path):
    """A stream that is started again with a new propagator goes on where the last one ended."""
    from bitweave.streaming import propagate_stream

    op = MajoranaOperator({(0, 1): 1j, (): 0.5}, 2)
    add_gates(spark, f"{tmp_path}/in", (0, [1, 2], 1.0, 0.3))
    p = MajoranaPropagator(op, [0], cutoff=4)
    propagate_stream(stream_of(spark, f"{tmp_path}/in"), p, f"{tmp_path}/ck").awaitTermination(120)
    add_gates(spark, f"{tmp_path}/in", (1, [0, 3], 1.0, -0.2))
    other = MajoranaPropagator(op, [0], cutoff=4)
    propagate_stream(stream_of(spark, f"{tmp_path}/in"), other, f"{tmp_path}/ck").awaitTermination(120)
    first, both = ([(1, 2)], [1.0], [0], 2, [0.3], [0]), ([(1, 2), (0, 3)], [1.0, 1.0], [0, 1], 2, [0.3, -0.2], [0])
    # the gates that come later act on the evolved operator: as a circuit they stand before the earlier ones
    want = MajoranaPropagator(op, [0], cutoff=4)
    want.propagate(Circuit.from_dense_arrays(*first))
    assert p.expectation_value() == pytest.approx(want.expectation_value(), abs=1e-12)
    want.propagate(Circuit.from_dense_arrays([both[0][1]], [1.0], [0], 2, [-0.2], [0]))
    assert other.expectation_value() == pytest.approx(want.expectation_value(), abs=1e-12)
    third = MajoranaPropagator(op, [0], cutoff=4)
    propagate_stream(stream_of(spark, f"{tmp_path}/in"), third, f"{tmp_path}/ck").awaitTermination(120)  # nothing new
    assert third.expectation_value() == other.expectation_value()


def test_stream_batch_is_not_applied_twice(spark, tmp_path):
    """The table of a batch was written, its commit was not: Spark replays the batch, its gates are skipped."""
    import shutil

    from bitweave.streaming import propagate_stream

    op = MajoranaOperator({(0, 1): 1j}, 2)
    add_gates(spark, f"{tmp_path}/in", (0, [1, 2], 1.0, 0.3))
    p = MajoranaPropagator(op, [0], cutoff=4)
    propagate_stream(stream_of(spark, f"{tmp_path}/in"), p, f"{tmp_path}/ck").awaitTermination(120)
    shutil.rmtree(f"{tmp_path}/ck/stream/commits")
    again = MajoranaPropagator(op, [0], cutoff=4)
    propagate_stream(stream_of(spark, f"{tmp_path}/in"), again, f"{tmp_path}/ck").awaitTermination(120)
    assert again.expectation_value() == p.expectation_value() != MajoranaPropagator(op, [0], cutoff=4).expectation_value()
