"""Dense-matrix versions of small problems."""

import numpy as np

ONE = {"I": np.eye(2), "X": np.array([[0, 1], [1, 0]], complex), "Y": np.array([[0, -1j], [1j, 0]]), "Z": np.diag([1, -1]).astype(complex)}


def kron(letters):
    out = np.eye(1)
    for x in letters:
        out = np.kron(out, ONE[x])
    return out


def pauli_matrix(operator):
    n = operator.num_qubits
    out = np.zeros((2**n, 2**n), complex)
    for p, c in operator.terms.items():
        letters = ["I"] * n
        for q, s in zip(p.qubits, p.string):
            letters[q] = s
        out += c * kron(letters)
    return out


def majorana_matrix(operator):
    n = operator.num_modes
    out = np.zeros((2**n, 2**n), complex)
    for key, c in operator.terms.items():
        m = np.eye(2**n, dtype=complex)
        for j in key:
            m = m @ kron("Z" * (j // 2) + "XY"[j % 2] + "I" * (n - j // 2 - 1))
        out += c * m
    return out


def matrix(operator):
    return pauli_matrix(operator) if hasattr(operator, "num_qubits") else majorana_matrix(operator)


def unitary(circuit, values=None):
    values = circuit.parameters if values is None else values
    u = np.eye(2**circuit.system_size, dtype=complex)
    for gate, p in zip(circuit.gates, circuit.resolved_mapping):
        w, v = np.linalg.eigh(matrix(gate.generator))
        u = v @ np.diag(np.exp(1j * values[p] * w)) @ v.conj().T @ u
    return u


def state(occupied, n):
    out = np.zeros(2**n)
    out[sum(1 << (n - 1 - i) for i in occupied)] = 1
    return out


def expectation(operator, circuit, occupied, values=None):
    b, u = state(occupied, circuit.system_size), unitary(circuit, values)
    return (b @ u.conj().T @ matrix(operator) @ u @ b).real
