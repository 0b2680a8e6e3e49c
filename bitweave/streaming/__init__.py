"""Rotations that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators.circuit import Circuit, ExpGate
from ..operators.terms import MajoranaOperator, Pauli, PauliOperator
from ..propagator import Propagator
from ..store import children, remove

GATES = "layer int, idx array<int>, gcoef double, angle double"


class _State:
    """The propagator's table after each micro-batch, in folders named by the batch's number beside the checkpoint."""

    def __init__(self, propagator: Propagator, folder: str):
        self.propagator, self.folder = propagator, folder

    def numbers(self) -> list[int]:
        """Batches whose table was written to its end."""
        spark = self.propagator.spark
        names = [n for n in children(spark, self.folder) if n.lstrip("-").isdigit()]
        return sorted(int(n) for n in names if "_SUCCESS" in children(spark, f"{self.folder}/{n}"))

    def save(self, number: int) -> None:
        p = self.propagator
        p.terms().withColumn("core", F.lit(p.core)).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        for old in [n for n in self.numbers() if n < number - 1]:  # the batch before may be read again after a failure
            remove(p.spark, f"{self.folder}/{old}")

    def load(self) -> int:
        """Put the last table into the propagator; -1 and its own table if there is none."""
        numbers = self.numbers()
        if not numbers:
            self.save(-1)
            return -1
        self.propagator.replace_terms(self.propagator.spark.read.parquet(f"{self.folder}/{numbers[-1]}").drop("core"))
        return numbers[-1]


def propagate_stream(gates: DataFrame, propagator: Propagator, checkpoint: str, *, once: bool = True):
    """Drive a propagator by a stream of (layer INT, idx ARRAY<INT>, gcoef DOUBLE, angle DOUBLE) rows.

    Each micro-batch's gates, in layer order, are one propagate() call. The table after a batch is written beside the
    stream's checkpoint under the batch's number before the batch is committed. A stream that starts again from its
    checkpoint, with any propagator of the same kind, goes on from the last table written, and a batch that Spark
    replays although its table is there is not applied twice. Returns the started query; once it has ended, propagator
    holds the result.
    """
    state = _State(propagator, f"{checkpoint.rstrip('/')}/tables")
    last = state.load()

    def apply(batch: DataFrame, number: int) -> None:
        nonlocal last
        if number <= last:
            return
        rows = batch.orderBy("layer").collect()  # gates, not data: a circuit's length
        if rows:
            n = propagator.num_modes
            if propagator.basis == "pauli":
                ops = [PauliOperator({Pauli.from_mask(B.mask_of(r["idx"])): r["gcoef"]}, n) for r in rows]
            else:
                ops = [MajoranaOperator({tuple(r["idx"]): r["gcoef"]}, n) for r in rows]
            circuit = Circuit([ExpGate(op, atol=0.0, structural=True) for op in ops], n, [r["angle"] for r in rows])
            propagator.propagate(circuit)
        state.save(number)
        last = number

    writer = gates.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()
