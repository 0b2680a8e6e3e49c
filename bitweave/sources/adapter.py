"""Optional adapter to qiskit objects; needs that package only when called."""

from __future__ import annotations

from ..operators.circuit import Circuit
from ..operators.terms import Pauli, PauliOperator
from .files import ROTATIONS, circuit_from_gate_list, gate_list_from_circuit


def from_qiskit_operator(op, *, atol: float = 1e-8) -> PauliOperator:
    """A sparse Pauli sum; its strings put qubit 0 last."""
    op = op.simplify(atol=atol)
    return PauliOperator.from_lists([Pauli(label[::-1]) for label in op.paulis.to_labels()], op.coeffs, op.num_qubits)


def to_qiskit_operator(op: PauliOperator):
    from qiskit.quantum_info import SparsePauliOp

    return SparsePauliOp.from_sparse_list([(p.string, list(p.qubits), c) for p, c in op.terms.items()], num_qubits=op.num_qubits)


def from_qiskit_circuit(circuit, initial_state) -> Circuit:
    if len(circuit.qregs) != 1:
        raise ValueError("one quantum register is needed")
    register, gates = list(circuit.qregs[0]), []
    for item in circuit.data:
        op, qubits = item.operation, [register.index(q) for q in item.qubits]
        if op.name == "PauliEvolution":
            gates.append((("evolution", from_qiskit_operator(op.operator)), qubits, op.time))
        else:
            gates.append((op.name, qubits, op.params[0] if op.name in ROTATIONS else 0.0))
    return circuit_from_gate_list(gates, len(register), initial_state)


def to_qiskit_circuit(circuit: Circuit, num_qubits: int):
    if num_qubits != circuit.system_size:
        raise ValueError(f"num_qubits={num_qubits} does not match circuit.system_size={circuit.system_size}")
    gates = gate_list_from_circuit(circuit)
    from qiskit.circuit import QuantumCircuit
    from qiskit.circuit.library import PauliEvolutionGate

    out = QuantumCircuit(num_qubits)
    for (_, op), qubits, value in gates:
        out.append(PauliEvolutionGate(to_qiskit_operator(op), value), qubits)
    return out
