"""Tokenise documents and pack their tokens into sequences of balanced attention cost."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ArrayBpe
from .common import partitions, written

TOKENS_SCHEMA = "shard long, doc_id long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in PIECE_SCHEMA.split(", ")])
_TOKENS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_MARK = b"\x01"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Places(dict):
    """Numbers words as they come, and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at


def pieces(text: bytes, size: int) -> list[bytes]:
    """The text cut into pieces of about `size` bytes before white space; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class WordTokenizer:
    """Token ids of texts, by a public tokenizer file whose tokens never span ASCII white space.

    Words (runs without ASCII white space) are encoded once and remembered; beyond max_words all are forgotten before the
    next texts. New words are encoded together, on arrays where ArrayBpe handles them and by the library elsewhere.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.bpe = ArrayBpe(path)
        self.reset()

    def reset(self) -> None:
        self.place = _Places()
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in one array, and their numbers: one call, with a mark between words that is a token."""
        if self.mark is not None and not any(_MARK in w for w in words):
            ids = np.array(self.tokenizer.encode(b" \x01 ".join(words).decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            marks = ids == self.mark
            cuts = np.flatnonzero(marks)
            if len(cuts) == len(words) - 1:
                return ids[~marks], np.diff(cuts, prepend=-1, append=len(ids)) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each])

    def _learn(self, words: list[bytes]) -> None:
        """Store the ids of words whose places, in this order, are the last ones given."""
        at = len(self.place) - len(words)
        groups = [(words, np.arange(len(words)))]
        if self.bpe.usable:
            ids, sizes, handled = self.bpe.encode(words)
            rest = np.flatnonzero(~handled)
            self._store(at + np.flatnonzero(handled), ids, sizes[handled])
            groups = [([words[i] for i in rest.tolist()], rest)]
        for some, rows in groups:
            for i in range(0, len(some), 1000):
                self._store(at + rows[i : i + 1000], *self._library(some[i : i + 1000]))

    def _store(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.place) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[at] = sizes
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: list[bytes], end_id: int, piece: int = 1 << 21) -> list[np.ndarray]:
        """Each text's ids, and end_id after them. A text beyond `piece` bytes is split at white space and taken piece by
        piece, so that the words of a very long one are never in memory together."""
        if any(len(t) > piece for t in texts):
            out = []
            for t in texts:
                parts = [self.encode([p], end_id, max(piece, len(p)))[0] for p in pieces(t, piece)]
                out.append(np.concatenate([p[:-1] for p in parts[:-1]] + parts[-1:]))
            return out
        split = [t.split() for t in texts]
        n = [len(w) for w in split]
        if len(self.place) > self.max_words:
            self.reset()
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, sum(n))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        sizes = self.sizes[at]
        total = np.cumsum(sizes)
        ids = self.flat[np.arange(len(at) and total[-1]) + np.repeat(self.starts[at] - total + sizes, sizes)]
        upto = np.concatenate((np.zeros(1, np.int64), total))[np.cumsum([0, *n])]
        end = np.array([end_id], np.uint32)
        return [np.concatenate((ids[a:b], end)) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file; its memory of words outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenized(docs: DataFrame, path: str, end_id: int, shard_chars: int, batch_bytes: int = 1 << 21) -> DataFrame:
    """(shard, doc_id, ids as little-endian uint32) per document, dealt by a hash of doc_id and text; shards hold about
    shard_chars code points. Rows that repeat both more often than a partition's share are dealt to several shards.
    Null and empty texts have the end id alone; an empty table gives no rows."""
    row = F.xxhash64("doc_id", "text")
    marks = written(docs.select(row.alias("row"), F.length("text").alias("points")), "marks")
    total, n = marks.agg(F.sum("points"), F.count(F.lit(1))).first()
    shards, share = max(1, -(-(total or 0) // shard_chars)), max(32, -(-n // partitions(docs.sparkSession)))
    hot = marks.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("row", F.ceil(F.col("n") / share).alias("parts"))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(hot), "row", "left")  # fewer rows than partitions
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    rows = rows.select(F.pmod(F.xxhash64("row", part), F.lit(shards)).alias("shard"), "doc_id", "text")

    def encode(batches):
        tokenizer = word_tokenizer(path)
        for batch in batches:
            shard, doc_id, texts = (batch.column(i).to_pylist() for i in range(3))
            texts, i = [t or b"" for t in texts], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < batch_bytes):
                    size, j = size + len(texts[j]), j + 1
                blobs = [x.astype("<u4").tobytes() for x in tokenizer.encode(texts[i:j], end_id)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[i:j], pa.int64()), pa.array(doc_id[i:j], pa.int64()), pa.array(blobs, pa.binary())], schema=_TOKENS)
                i = j

    return rows.mapInArrow(encode, TOKENS_SCHEMA)


def capacities(total: int, longest: int) -> list[int]:
    """Full sequences, then the binary digits of the rest: a power of two needs no padding."""
    full, rest = divmod(total, longest)
    return [longest] * full + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def balance(lengths: list[int], longest: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of documents packed by cost.

    A piece costs linear * n + quadratic * n * n. Documents go in descending length to the sequence of lowest cost
    that has room; one longer than a sequence, or than any room left, is cut to the largest room.
    """
    room = np.array(capacities(sum(lengths), longest), np.int64)
    cost = np.zeros(len(room))
    out = []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[doc]
        while left:
            fits = room >= left
            if fits.any():
                at, n = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                most = int(room.max())
                at, n = int(np.where(room == most, cost, np.inf).argmin()), most
            out.append((doc, start, n, at))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = 4096, end_id: int = 2, shard_chars: int = 4_000_000) -> DataFrame:
    """Cost-balanced packing of all documents into sequences of at most sequence_tokens tokens.

    Each document's ids are the tokenizer's, without special tokens added, then end_id. Documents are dealt by hash to
    shards of about shard_chars code points; each shard is packed by balance() and has no padding at all: its
    sequences are full, but for at most one of each smaller power of two. Returns one row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id (unique over shards), offset (gapless from 0 in each sequence).
    docs needs doc_id and text; other columns are ignored. Null and empty texts are the end id alone; repeated rows
    and null doc_ids are packed like any other; an empty table gives an empty result. Ties go to the row that comes
    first by doc_id, then to the earlier sequence.
    """

    def pack_shard(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        docs = sorted(((d is None, d or 0, b) for d, b in zip(rows["doc_id"].to_pylist(), rows["ids"].to_pylist())))
        lengths = [len(b) // 4 for _, _, b in docs]
        filled: dict[int, int] = {}
        out = []
        for doc, start, n, at in balance(lengths, sequence_tokens):
            missing, doc_id, ids = docs[doc]
            offset = filled.get(at, 0)
            filled[at] = offset + n
            out.append((None if missing else doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), lengths[doc], shard << 32 | at, offset))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], schema=_PIECE)

    return tokenized(docs, tokenizer_path, end_id, shard_chars).groupBy("shard").applyInArrow(pack_shard, PIECE_SCHEMA)
