"""Shared helpers of the training-data operators: shared folder, written intermediates, chunk packing."""

from __future__ import annotations

import math
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import discard, keep, local_frame, shared_folder

#: ASCII white space that separates words: the characters of [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\v\f\r"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/bitweave-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    return keep(df, name, codec)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def boxed(docs: DataFrame, **more) -> DataFrame:
    """docs' whole rows in one column `doc`, and columns of our own beside it: no name of docs can clash with them."""
    return docs.select(F.struct("*").alias("doc"), *[c.alias(n) for n, c in more.items()])


def free_names(taken, names) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from those taken, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


#: A joined table of narrow rows is broadcast up to this many.
BROADCAST_ROWS = 20_000


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: list[str], how: str = "inner", total: int | None = None, counts: DataFrame | None = None, one_rows: int | None = None) -> DataFrame:
    """many.join(one, on, how) for a `one` that holds each key once, however skewed the keys of `many` are.

    one_rows, if known: up to BROADCAST_ROWS rows of `one` are broadcast and nothing is shuffled. Otherwise
    a key that holds more than twice a partition's share of the rows is split by a hash of `by` into parts of one share
    each, and its row of `one` is copied to them. At most half as many keys as partitions can be that common, and their
    parts are fewer than twice the partitions: a proven bound for the list of them. counts: (on.., n), if known; it may
    overstate n. Null keys match nothing.
    """
    if one_rows is not None and one_rows <= BROADCAST_ROWS:
        return many.join(F.broadcast(one), on, how)
    spark = many.sparkSession
    n = partitions(spark)
    total = many.count() if total is None else total
    share = max(32, -(-total // n))
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > 2 * share).select(*on, F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    rows = hot.collect()  # half as many rows as partitions at most
    if not rows:
        return many.join(one, on, how)
    hot = F.broadcast(local_frame(spark, rows, hot.schema))
    left = many.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = one.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def growth(docs: DataFrame, unit: int = 30 << 30) -> float:
    """How far chunks and buckets grow beyond `unit` bytes of input, by Catalyst's estimate: with its root, so that a
    chunk keeps its number of keys per bucket while both numbers grow with the root, too. 1 where the estimate is no
    more than a default; results do not depend on it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return math.sqrt(max(size / unit, 1.0)) if size < 1 << 50 else 1.0


# --- texts packed into durable chunks -------------------------------------------------------------------------

CHUNK_SCHEMA = "chunk long, n_words long, ids array<long>, lens array<long>, texts binary"


def pack_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Pack (doc_id, text) rows into rows of about chunk_bytes of UTF-8 text each; a null text has length -1.

    A longer document is a chunk of its own. Chunk ids come from the task and its place in it, so the result must be
    written() before it is read more than once.
    """
    import pyarrow as pa

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=1).compress
        ids, parts, size = [], [], 0

        def row():
            nonlocal seq
            texts = b"\n".join(p or b"" for p in parts)
            n = int(len(word_bounds(np.frombuffer(texts, np.uint8))[0])) if texts else 0
            out = pa.RecordBatch.from_pylist(
                [{"chunk": part << 32 | seq, "n_words": n, "ids": ids, "lens": [-1 if p is None else len(p) for p in parts], "texts": compress(texts)}],
                schema=pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("texts", pa.binary())]),
            )
            seq += 1
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                parts.append(raw)
                size += len(raw or b"") + 1
                if size >= chunk_bytes or len(parts) >= 50_000:
                    yield row()
                    ids, parts, size = [], [], 0
        if parts:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(pack, CHUNK_SCHEMA)


def unpack(texts: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(texts) if texts else b""


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in UTF-8 bytes."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.ones(256, bool)
    word[[32, 9, 10, 11, 12, 13]] = False
    inside = np.concatenate(([False], word[buf], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def doc_starts(lens) -> np.ndarray:
    """Byte offset of each document in its chunk; documents are joined by one newline."""
    sizes = np.maximum(np.asarray(lens, np.int64), 0) + 1
    return np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.empty(0, np.int64)


# --- 64-bit hashes of words and windows, on numpy arrays ------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done, step = 1, np.uint64(base)
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * step
        done += k
        step = np.uint64(int(step) ** 2 & (2**64 - 1))
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_BYTE_2 = mix(np.arange(257, 513, dtype=np.uint64) * _P)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another one, independent of it, on demand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    table, base = (_BYTE_2, 0x9FB21C651E98DF25) if second else (_BYTE, 0xC2B2AE3D27D4EB4F)
    power = powers(int(lens.max()), base)
    total = np.concatenate(([0], np.cumsum(lens)))
    out = np.empty(len(lens), np.uint64)
    at = 0
    while at < len(lens):  # some 256 KB at a time: the arrays below take 32 bytes a byte
        end = min(len(lens), max(at + 1, int(np.searchsorted(total, total[at] + (1 << 18)))))
        place = np.arange(total[end] - total[at]) - np.repeat(total[at:end] - total[at], lens[at:end])
        value = table[buf[place + np.repeat(starts[at:end], lens[at:end])]] * power[place]
        out[at:end] = mix(np.add.reduceat(value, total[at:end] - total[at]) + lens[at:end].astype(np.uint64))
        at = end
    return out


def window_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every window of `length` consecutive words; shorter input gives none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1) + 4 * seed) & (2**64 - 1) | 1
    inverse = pow(base, -1, 2**64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(len(words), base))))
    return mix((sums[length:] - sums[:-length]) * powers(n, inverse) + np.uint64(seed))
