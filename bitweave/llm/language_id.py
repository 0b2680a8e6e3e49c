"""Language ID by the nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_frame

OUT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
DIMENSIONS = 4096
PIECE = 1 << 19  # code points handled at a time
UNKNOWN = "und"
FULL = 256  # distinct n-grams from which a text's cosine no longer hangs on its length


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def n_gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed letter bigrams and trigrams, one row per text. Runs of other characters are word ends."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    pieces, rows, size = [], [], 0

    def flush():
        nonlocal pieces, rows, size
        if not pieces:
            return
        x = np.concatenate(pieces)
        row = np.repeat(np.array(rows), [len(p) for p in pieces])
        x = np.where(_letters()[x], x, 0).astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        same = row[:-2] == row[2:]
        tri = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        bi = (b * np.uint32(0x27D4EB2F)) ^ (c * np.uint32(0x165667B1))
        for key, ok in ((tri, same & (b > 0)), (bi, same & ((b > 0) | (c > 0)))):
            key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            at = row[2:][ok] * DIMENSIONS + (key[ok] >> np.uint32(20)).astype(np.int64)
            first = int(rows[0])
            n = int(rows[-1]) - first + 1
            out[first : first + n] += np.bincount(at - first * DIMENSIONS, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
        pieces, rows, size = [], [], 0

    for i, text in enumerate(texts):
        text = text.lower()
        for start in range(0, max(len(text), 1), PIECE):
            part = " " * (2 if not start else 0) + text[max(0, start - 2) : start + PIECE] + " " * (start + PIECE >= len(text))
            pieces.append(np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32))
            rows.append(i)
            size += len(part)
            if size >= PIECE:
                flush()
    flush()
    return out


def has_letter(counts: np.ndarray) -> np.ndarray:
    """A text with a letter has n-grams; one without has none."""
    return counts.any(axis=1)


def reach(counts: np.ndarray) -> np.ndarray:
    """The share of a full text's cosine that a text can be held to: it grows with the root of the distinct n-grams."""
    return np.sqrt(np.minimum(1.0, np.count_nonzero(counts, axis=1) / FULL))


@dataclass
class Model:
    """languages[owner[i]] owns centroid i; a text is accepted if its cosine with its nearest centroid i is at least
    floors[i] times its reach."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine with its nearest centroid, and whether that is below what is asked of a text of its length."""
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(cosine)), best], 0, 1).astype(float)
        known = has_letter(counts)
        names = [self.languages[o] if k else UNKNOWN for o, k in zip(self.owner[best], known)]
        return names, np.where(known, score, 0.0), ~known | (score < self.floors[best] * reach(counts))


def fit(counts: np.ndarray, langs: list[str], clusters: int = 4, rounds: int = 12, slack: float = 0.5, low: float = 0.05, seed: int = 7) -> Model:
    """Spherical k-means of each language's vectors. A language's floor lies slack of the way from the low quantile of
    its training texts' cosines, each divided by the text's reach, to 0; so neither a few odd texts nor short ones
    decide it. Texts without n-grams are not learned from."""
    known = has_letter(counts)
    counts, langs = counts[known], [x for x, k in zip(langs, known) if k]
    languages = sorted(set(langs))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(languages, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    x, mine = model.vectors(counts), np.array([languages.index(x) for x in langs], int)
    random = np.random.default_rng(seed)
    centres, owner = [], []
    for k in range(len(languages)):
        own = x[mine == k]
        c = own[random.permutation(len(own))[:clusters]]
        for _ in range(rounds):
            near = (own @ c.T).argmax(axis=1)
            c = np.stack([own[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        centres.append(c)
        owner += [k] * len(c)
    if languages:
        model.centroids, model.owner = np.concatenate(centres).astype(np.float32), np.array(owner)
        cosine = x @ model.centroids.T
        full = [np.where(model.owner == k, cosine, -1).max(axis=1)[mine == k] / reach(counts[mine == k]) for k in range(len(languages))]
        model.floors = np.array([(1 - slack) * min(1.0, np.quantile(f, low)) for f in full])[model.owner]
    return model


def held_out(doc_id):
    """Documents never learned from: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample_texts: int = 2000, seed: int = 7) -> Model:
    """Fit on about sample_texts labelled texts, none of them held out or without a letter: an equal share of each
    language's, chosen by a hash of the doc_id. That bound is the classifier's only one, on its languages, too (the most
    frequent ones, should there be more labels than texts to learn from); prediction covers all documents. Without a
    labelled text the model knows no language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.select("lang", "doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)).alias("draw"))
    sizes = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(sample_texts)  # sample_texts rows at most
    sizes = {r["lang"]: r["count"] for r in sizes.collect()}
    each = max(1, sample_texts // max(1, len(sizes)))
    # a few more than needed, then exactly `each` below
    share = [(lang, int(min(1.0, (each + 5 * each**0.5 + 10) / n) * (1 << 30))) for lang, n in sizes.items()]
    shares = F.broadcast(local_frame(docs.sparkSession, share, "lang string, share long"))

    def count(batches):
        for batch in batches:
            lang, draw, texts = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(texts), 64):
                blobs = [x.tobytes() for x in n_gram_counts(texts[i : i + 64])]
                yield pa.RecordBatch.from_arrays([pa.array(lang[i : i + 64], pa.string()), pa.array(draw[i : i + 64], pa.int64()), pa.array(blobs, pa.binary())], names=["lang", "draw", "counts"])

    rows = labelled.join(shares, "lang").where("draw < share").select("lang", "draw", "text").mapInArrow(count, "lang string, draw long, counts binary").collect()
    chosen: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], bytes(r["counts"]))):
        if len(chosen.setdefault(r["lang"], [])) < each:
            chosen[r["lang"]].append(np.frombuffer(r["counts"], np.float32))
    counts = np.stack([c for cs in chosen.values() for c in cs]) if chosen else np.zeros((0, DIMENSIONS), np.float32)
    return fit(counts, [k for k, cs in chosen.items() for _ in cs])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            doc_id, out, texts = (batch.column(i).to_pylist() for i in range(3))
            for i in range(0, len(texts), 256):
                part = slice(i, i + 256)
                names, score, far = model.predict(n_gram_counts([t or "" for t in texts[part]]))
                yield pa.RecordBatch.from_arrays([pa.array(doc_id[part], pa.int64()), pa.array(out[part], pa.bool_()), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), "text").mapInArrow(run, OUT_SCHEMA)


def identify(docs: DataFrame, sample_texts: int = 2000) -> DataFrame:
    """Predict every document's language: doc_id, held_out, lang_pred, score, rejected.

    Learns from text and non-null lang of documents that are not held out; prediction reads the whole text alone.
    score is the cosine with the nearest centroid; rejected means that it is below the floor of the centroid's language,
    which is lower for texts of few distinct n-grams.
    Null texts and texts without a letter are `und`, score 0, rejected. Without any labelled text all are. Repeated rows
    are predicted alike, ties go to the first language in alphabetical order, an empty table gives an empty result.
    docs needs doc_id, text and lang; other columns are ignored.
    """
    return predict(docs, train(docs, sample_texts))


def accepted(docs: DataFrame, sample_texts: int = 2000) -> DataFrame:
    """The documents that identify() does not reject, with all their columns: null texts and those without a letter go,
    rows without doc_id and repeated rows stay or go by their texts; an empty table gives an empty result."""
    model = train(docs, sample_texts)

    at = docs.columns.index("text")

    def near(batches):
        # whole rows pass through the same kind of worker as everything else: no second pool of Python processes
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [~model.predict(n_gram_counts([t or "" for t in texts[i : i + 256]]))[2] for i in range(0, len(texts), 256)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(near, docs.schema)
