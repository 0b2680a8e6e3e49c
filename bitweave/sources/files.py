"""Single-file formats: Pauli-string JSON, integral dumps, plain gate lists, and fermionic JSON."""

from __future__ import annotations

import ast
import json
import re

import numpy as np
from pyspark.sql import SparkSession

from ..operators.circuit import Circuit, ExpGate
from ..operators.terms import FermiOperator, Pauli, PauliOperator

#: Names of single-rotation gates that a plain list may use; r<letters>(t) is exp(-i t/2 <letters>).
ROTATIONS = ("rx", "ry", "rz", "rxx", "ryy", "rzz", "rxy", "rxz", "ryz")


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text, through Spark's readers, so that any store works."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_pauli_json(spark: SparkSession, path: str) -> PauliOperator:
    """{full-width Pauli string: coefficient}"""
    terms = json.loads(_text(spark, path))
    return PauliOperator(terms, max(map(len, terms), default=0))


def read_fermi_json(spark: SparkSession, path: str, num_modes: int) -> FermiOperator:
    """{"((mode, 0 or 1), ..)": coefficient}; 1 raises, 0 lowers."""
    terms = {}
    for key, value in json.loads(_text(spark, path)).items():
        terms[tuple((m, "+" if up else "-") for m, up in ast.literal_eval(key))] = value
    return FermiOperator.from_dict(terms, num_modes)


def read_fcidump(spark: SparkSession, path: str) -> tuple[float, np.ndarray, np.ndarray]:
    """h0, h1 (2, n, n) and h2 (3, n, n, n, n) of a restricted integral dump with eightfold symmetry.

    The opposite-spin block is halved and symmetrised over its electrons, as the conversion expects it.
    """
    text = _text(spark, path)
    head, _, body = text.partition("&END") if "&END" in text else text.partition("/")
    n = int(re.search(r"NORB\s*=\s*(\d+)", head)[1])
    h0, one, two = 0.0, np.zeros((n, n)), np.zeros((n, n, n, n))
    for line in body.split("\n"):
        if not (parts := line.replace("D", "E").split()):
            continue
        value, (i, j, k, m) = float(parts[0]), (int(x) - 1 for x in parts[1:5])
        if k >= 0:
            for a, b in ((i, j), (j, i)):
                for c, d in ((k, m), (m, k)):
                    two[a, b, c, d] = two[c, d, a, b] = value
        elif j >= 0:
            one[i, j] = one[j, i] = value
        elif i < 0:
            h0 = value
    return h0, np.array([one, one]), np.array([two, two, 0.5 * (two + two.transpose(2, 3, 0, 1))])


def circuit_from_gate_list(gates, num_qubits: int, initial_state=None) -> Circuit:
    """(name, qubits, value) triples: a rotation name, 'barrier' (skipped), or 'evolution' with a PauliOperator on
    0 .. len(qubits) - 1 in place of the name's letters, as (('evolution', operator), qubits, time).

    Rotations are exp(-i t/2 P) and evolutions exp(-i t H), so generators are negated and the values stay the angles.
    """
    out, values = [], []
    for name, qubits, value in gates:
        if name == "barrier":
            continue
        if isinstance(name, tuple) and name[0] == "evolution":
            terms = {Pauli(p.string, [qubits[q] for q in p.qubits]): -c for p, c in name[1].terms.items()}
        elif name in ROTATIONS:
            terms = {Pauli(name[1:].upper(), qubits): -0.5}
        else:
            raise ValueError(f"Unsupported gate {name}")
        out.append(ExpGate(PauliOperator(terms, num_qubits)))
        values.append(float(value))
    return Circuit(out, num_qubits, values, initial_state)


def gate_list_from_circuit(circuit: Circuit) -> list:
    """The triples of a bound Pauli circuit, each gate an evolution on the qubits that it touches."""
    if circuit.family == "majorana":
        raise TypeError("a majorana-family gate cannot be written as Pauli evolutions")
    if not circuit.bound:
        raise ValueError("a bound circuit is needed")
    out = []
    for gate, p in zip(circuit.gates, circuit.resolved_mapping):
        terms = gate.generator.terms
        qubits = sorted({q for t in terms for q in t.qubits})
        local = {Pauli(t.string, [qubits.index(q) for q in t.qubits]): -c for t, c in terms.items()}
        out.append((("evolution", PauliOperator(local, len(qubits))), qubits, circuit.parameters[p]))
    return out
