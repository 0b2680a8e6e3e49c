"""Count keys over all chunks without a row per key.

Each chunk sends its distinct keys, sorted and cut into buckets, as one binary row per bucket; the bucket's owner
counts them and answers one bit per key. A key that every document holds is sent once per chunk, so no task gathers
more than (chunks x bucket share) keys, however common a key is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ASK_SCHEMA = "bucket long, chunk long, keys binary, many binary"
ANSWER_SCHEMA = "level int, chunk long, bucket long, bits binary, n long"
_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
_ANSWER = pa.schema([("level", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())])


def bucket_count(n_keys: int, entries: int, least: int) -> int:
    return max(least, -(-n_keys // entries), 1)


def distinct(keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted distinct keys, whether each occurs more than once, and their second halves, if there are any."""
    if not len(keys):
        return keys, np.empty(0, bool), second
    if second is None:
        ordered = np.sort(keys)
        new = ordered[1:] != ordered[:-1]
    else:
        order = np.lexsort((second, keys))
        ordered, second = keys[order], second[order]
        new = (ordered[1:] != ordered[:-1]) | (second[1:] != second[:-1])
    first = np.flatnonzero(np.concatenate(([True], new)))
    return ordered[first], np.diff(np.append(first, len(ordered))) > 1, None if second is None else second[first]


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: equal ranges of the keys' leading 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def edges(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that these sorted keys use, and where each one's keys begin, with the end."""
    if not len(keys):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    of = buckets_of(keys, buckets).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return of[first], np.append(first, len(keys))


def ask(chunk: int, keys: np.ndarray, many: np.ndarray, second: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """The rows that a chunk sends. Without second halves, keys keep 32 bits within their bucket: a prefilter that never
    misses. With them a key has 128 bits."""
    used, at = edges(keys, buckets)
    sent = [keys.astype(np.uint32)] if second is None else [keys, second]
    cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
    cols = [used, [chunk] * len(used), [b"".join(k[a:b].tobytes() for k in sent) for a, b in cuts], [np.packbits(many[a:b]).tobytes() for a, b in cuts]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ASK)], schema=_ASK)


def answers(asked: DataFrame, level: int, exact: bool) -> DataFrame:
    """One bit per key asked for: does it occur twice or more over all chunks? n counts those that do. exact: keys have
    both halves."""

    def owner(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint64 if exact else np.uint32) for b in rows["keys"].to_pylist()]
        sizes = [len(b) // 2 if exact else len(b) for b in blobs]
        keys = np.concatenate([b[:n] for b, n in zip(blobs, sizes)])
        many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["many"].to_pylist(), sizes)]).astype(bool)
        if exact:
            second = np.concatenate([b[n:] for b, n in zip(blobs, sizes)])
            order = np.lexsort((second, keys))
            new = (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])
        else:
            order = np.argsort(keys)
            new = keys[order][1:] != keys[order][:-1]
        first = np.concatenate(([True], new))
        start = np.flatnonzero(first)
        repeated = (np.diff(np.append(start, len(keys))) > 1) | np.logical_or.reduceat(many[order], start)
        bits = np.empty(len(keys), bool)
        bits[order] = repeated[np.cumsum(first) - 1]
        parts = np.split(bits, np.cumsum(sizes)[:-1])
        cols = [pa.array([level] * len(sizes), pa.int32()), rows["chunk"], rows["bucket"], pa.array([np.packbits(x).tobytes() for x in parts], pa.binary()), pa.array([int(x.sum()) for x in parts], pa.int64())]
        return pa.table(cols, schema=_ANSWER)

    return asked.groupBy("bucket").applyInArrow(owner, ANSWER_SCHEMA)


def read_answer(keys: np.ndarray, rows: pa.Table, level: int, buckets: int) -> np.ndarray:
    """Which of a chunk's sorted distinct keys are repeated, from the answers that came back to it."""
    used, at = edges(keys, buckets)
    place = {b: i for i, b in enumerate(used.tolist())}
    bits = np.zeros(len(keys), bool)
    for its_level, bucket, blob in zip(rows["level"].to_pylist(), rows["bucket"].to_pylist(), rows["bits"].to_pylist()):
        if its_level == level:
            a, b = at[place[bucket]], at[place[bucket] + 1]
            bits[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
    return bits


def among(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted members."""
    if not len(members):
        return np.zeros(len(keys), bool)
    return members[np.minimum(np.searchsorted(members, keys), len(members) - 1)] == keys
