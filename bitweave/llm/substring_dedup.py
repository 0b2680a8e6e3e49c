"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import doc_starts, growth, pack_chunks, partitions, unpack, window_hashes, word_bounds, word_hashes, written

OUT_SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,length:long>>, kept_text string"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept_text", pa.string())]
)


def levels(window: int, base: int) -> list[int]:
    """Window lengths that double (rounding down at most one word short) up to `window`; the first is at least base."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= base:
        out.insert(0, half)
    return out


class _Chunk:
    """A chunk's words, their hashes, and the word windows that stay candidates level by level."""

    def __init__(self, lens, texts: bytes):
        self.buf = np.frombuffer(texts, np.uint8)
        self.starts, self.ends = word_bounds(self.buf)
        self.hashes = word_hashes(self.buf, self.starts, self.ends)
        self.doc_word = np.searchsorted(self.starts, doc_starts(lens))  # the first word of each document
        self.doc_end = np.append(self.doc_word[1:], len(self.starts))
        self.end = np.repeat(self.doc_end, self.doc_end - self.doc_word)

    def windows(self, length: int, before: np.ndarray | None, before_length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of a level: all within a document at first, then those whose first and
        last window of the level before were both repeated."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        ok = self.end[:n] - np.arange(n) >= length
        if before is not None:
            shift = length - before_length
            ok &= before[:n] & before[shift : shift + n]
        at = np.flatnonzero(ok)
        return at, window_hashes(self.hashes, length, seed=length)[at]

    def seconds(self, length: int, at: np.ndarray) -> np.ndarray:
        """Second 64 bits of the windows that start at these words, from other hashes of the words and other sums."""
        if not len(at):
            return np.empty(0, np.uint64)
        return window_hashes(word_hashes(self.buf, self.starts, self.ends, second=True), length, seed=length + (1 << 20))[at]

    def repeated(self, rows: pa.Table, lengths: list[int], buckets: int, exact: bool) -> np.ndarray:
        """Per word: does a repeated window of the last of these lengths start here? exact: that is the last level."""
        mask = None
        for level, length in enumerate(lengths):
            at, keys = self.windows(length, mask, lengths[level - 1])
            mask = np.zeros(len(self.hashes), bool)
            if not exact or level < len(lengths) - 1:
                ordered = X.distinct(keys)[0]
                mask[at[X.among(keys, ordered[X.read_answer(ordered, rows, level, buckets)])]] = True
            elif len(keys):
                second = self.seconds(length, at)
                order = np.lexsort((second, keys))
                ordered, second = keys[order], second[order]
                first = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (second[1:] != second[:-1])))
                mask[at[order[X.read_answer(ordered[first], rows, level, buckets)[np.cumsum(first) - 1]]]] = True
        return mask


def remove_repeats(docs: DataFrame, window: int = 35, base: int = 9, chunk_bytes: int = 3 << 20, bucket_entries: int = 500_000) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that starts at two or more places of the corpus.

    Words are runs without ASCII white space, compared unchanged. Windows of window/4, window/2, .. words, from the
    shortest of at least `base`, are counted first; only where both halves repeat is the window of twice the length a
    candidate. The doubling ends at `window` words, or once no candidate survives. Every position of every text is
    counted; windows are judged on the input. The shorter levels are prefilters with 32 bits of a window's hash within a
    bucket, which may only let too many through; the last one compares 128 bits of two independent hashes.

    Chunks of about chunk_bytes and buckets of about bucket_entries keys grow with the root of inputs beyond 30 GB, and
    so does a task's memory: some 14 bytes a byte of the chunk's text, and 40 bytes a key of the bucket. A document is
    in one chunk, so the longest one needs as much.

    docs needs doc_id and text; other columns are ignored. Returns one row per input row: doc_id, n_words, n_removed,
    removed (spans of word positions) and kept_text (the kept words joined by one space).
    Null text counts as empty: no words, nothing removed, kept_text ''. Null or repeated doc_ids are kept as they are;
    repeated rows repeat each other's windows and so lose them. A text shorter than the window loses nothing.
    An empty table gives an empty result.
    """
    more = growth(docs)
    chunks = written(pack_chunks(docs, int(chunk_bytes * more)), "chunks", "uncompressed")
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    lengths = levels(window, base)
    buckets = X.bucket_count(n_words, int(bucket_entries * more), partitions(docs.sparkSession))
    done: DataFrame | None = None
    for level in range(len(lengths)):
        exact = level == len(lengths) - 1
        asked = chunks.mapInArrow(_ask_all(lengths, buckets, exact), X.ASK_SCHEMA) if done is None else _with_answers(chunks, done, _ask_some(lengths[: level + 1], buckets, exact), X.ASK_SCHEMA)
        found = written(X.answers(asked, level, exact), f"answers{level}")
        if not found.agg(F.sum("n")).first()[0]:  # no candidate survives
            return chunks.mapInArrow(_whole, OUT_SCHEMA)
        done = found if done is None else done.unionByName(found)
    return _with_answers(chunks, done, _cut(lengths, buckets), OUT_SCHEMA)


def _with_answers(chunks: DataFrame, done: DataFrame, function, schema: str) -> DataFrame:
    return chunks.groupBy("chunk").cogroup(done.groupBy("chunk")).applyInArrow(function, schema)


def _ask_all(lengths, buckets, exact):
    def function(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row["lens"], unpack(row["texts"]))
                at, keys = c.windows(lengths[0], None, 0)
                yield X.ask(row["chunk"], *X.distinct(keys, c.seconds(lengths[0], at) if exact else None), buckets)

    return function


def _ask_some(lengths, buckets, exact):
    def function(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            c = _Chunk(row["lens"], unpack(row["texts"]))
            at, keys = c.windows(lengths[-1], c.repeated(found, lengths[:-1], buckets, False), lengths[-2])
            out.append(X.ask(row["chunk"], *X.distinct(keys, c.seconds(lengths[-1], at) if exact else None), buckets))
        return pa.Table.from_batches(out, schema=X._ASK)

    return function


def _whole(batches):
    """Nothing is repeated: every document as it is."""
    for batch in batches:
        for row in batch.to_pylist():
            c = _Chunk(row["lens"], unpack(row["texts"]))
            yield _outcome(c, row["ids"], np.zeros(len(c.hashes), bool))


def _cut(lengths, buckets):
    window = lengths[-1]

    def function(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            c = _Chunk(row["lens"], unpack(row["texts"]))
            n = len(c.hashes)
            start = c.repeated(found, lengths, buckets, True)
            cover = np.zeros(n + window + 1, np.int32)
            at = np.flatnonzero(start)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover[:n]) > 0
            out.append(_outcome(c, row["ids"], gone))
        return pa.Table.from_batches(out, schema=_OUT)

    return function


def _outcome(c: _Chunk, ids, gone: np.ndarray) -> pa.RecordBatch:
    kept = ~gone
    sizes = (c.ends - c.starts + 1)[kept]  # with one space after each word
    total = np.concatenate(([0], np.cumsum(sizes)))
    edge = np.zeros(len(c.buf) + 2, np.int8)
    edge[c.starts[kept]] += 1
    edge[c.ends[kept] + 1] -= 1
    joined = np.append(c.buf, np.uint8(32))[np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)]
    joined[total[1:] - 1] = 32
    upto = np.concatenate(([0], np.cumsum(kept)))  # kept words before each word
    a, b = upto[c.doc_word], upto[c.doc_end]
    raw = joined.tobytes()
    texts = [raw[total[i] : total[j] - 1] if j > i else b"" for i, j in zip(a.tolist(), b.tolist())]
    spans = []
    for first, end, n in zip(c.doc_word.tolist(), c.doc_end.tolist(), (c.doc_end - c.doc_word - (b - a)).tolist()):
        if not n:
            spans.append([])
            continue
        e = np.diff(np.concatenate(([0], gone[first:end].view(np.int8), [0])))
        up, down = np.flatnonzero(e == 1), np.flatnonzero(e == -1)
        spans.append([{"start": i, "length": j - i} for i, j in zip(up.tolist(), down.tolist())])
    n_words = c.doc_end - c.doc_word
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_words - (b - a), pa.int64()), pa.array(spans, _OUT.field("removed").type), pa.array(texts, pa.binary()).cast(pa.string())], schema=_OUT
    )
