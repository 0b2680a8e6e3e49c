"""N-gram Jaccard self-join by vertical partitioning of the shingle order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import boxed, discard, doc_starts, growth, mix, pack_chunks, partitions, spread_join, unpack, window_hashes, word_bounds, word_hashes, written
from .graph import components

SETS_SCHEMA = "doc_id long, n long, sig binary, tokens binary, prefix binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary()), ("prefix", pa.binary())])
PARTIAL_SCHEMA = "block string, fragment int, sigs binary, sizes binary, x binary, y binary, shared binary"
_PARTIAL = pa.schema([("block", pa.string()), ("fragment", pa.int32()), *((c, pa.binary()) for c in ("sigs", "sizes", "x", "y", "shared"))])
LINK_SCHEMA = "a binary, b binary, links long"
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def least_shared(n, m, percent: int):
    """Fewest common shingles with 100 * common >= percent * union, for sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def may_miss(n, percent: int):
    """Most shingles of a set of n that a partner can lack."""
    return n - -(-percent * n // 100)


class _Sets:
    """The distinct shingles of a chunk's documents: values[at[i] : at[i + 1]], ascending, and 16-byte signatures."""

    def __init__(self, lens, texts: bytes, width: int):
        buf = _LOWER[np.frombuffer(texts, np.uint8)]
        starts, ends = word_bounds(buf)
        words = word_hashes(buf, starts, ends)
        first = np.searchsorted(starts, doc_starts(lens))
        end = np.append(first[1:], len(starts))
        windows = window_hashes(words, width, seed=width)
        sets = []
        for a, b in zip(first.tolist(), end.tolist()):
            if b - a >= width:
                sets.append(np.unique(windows[a : b - width + 1]))
            else:
                sets.append(window_hashes(words[a:b], b - a, seed=b - a) if b > a else words[:0])
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.values = np.concatenate(sets) if sets else words[:0]
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.values ^ np.uint64(c))))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        sums = [s[self.at[1:]] - s[self.at[:-1]] for s in sums]
        self.sigs = [np.array(x, np.uint64).tobytes() for x in zip(sums[0], sums[1])]

    def firsts(self) -> np.ndarray:
        """The first document of each distinct set; empty sets are left out."""
        seen, out = set(), []
        for i, (sig, n) in enumerate(zip(self.sigs, self.sizes.tolist())):
            if n and (sig, n) not in seen:
                seen.add((sig, n))
                out.append(i)
        return np.array(out, np.int64)

    def keys(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of these documents, and how many of them hold each (255 at most)."""
        if not len(docs):
            return self.values[:0], np.empty(0, np.uint8)
        ordered = np.sort(np.concatenate([self.values[self.at[i] : self.at[i + 1]] for i in docs.tolist()]))
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        return ordered[first], np.minimum(np.diff(np.append(first, len(ordered))), 255).astype(np.uint8)


def _frequencies(asked: DataFrame) -> DataFrame:
    """A class of each shingle's document frequency: 0 for one set, then 8 * log2(frequency). Keys keep 32 bits within
    a bucket, so a class can be too high and never too low: no partner is missed."""

    def owner(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint32) for b in rows["keys"].to_pylist()]
        keys = np.concatenate(blobs)
        counts = np.concatenate([np.frombuffer(b, np.uint8) for b in rows["many"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(counts[order], np.flatnonzero(first))
        grade = np.minimum(np.ceil(8 * np.log2(total)), 255).astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = grade[np.cumsum(first) - 1]
        parts = np.split(out, np.cumsum([len(b) for b in blobs])[:-1])
        return pa.table([pa.array([0] * len(blobs), pa.int32()), rows["chunk"], rows["bucket"], pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int64())], schema=X._ANSWER)

    return asked.groupBy("bucket").applyInArrow(owner, X.ANSWER_SCHEMA)


def shingle_sets(docs: DataFrame, width: int, percent: int, chunk_bytes: int = 3 << 20, bucket_entries: int = 500_000) -> DataFrame:
    """Every document's set size and signature, and the shingles of sets that can have a partner.

    A shingle that only one set holds is in no intersection; a set with more such shingles than a partner may lack has
    no partner. The others keep their shared shingles, and their prefix: the rarest ones, of which any partner holds
    at least one.
    """
    more = growth(docs)
    chunks = written(pack_chunks(docs, int(chunk_bytes * more)), "chunks", "uncompressed")
    buckets = X.bucket_count(chunks.agg(F.sum("n_words")).first()[0] or 0, int(bucket_entries * more), partitions(docs.sparkSession))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _Sets(row["lens"], unpack(row["texts"]), width)
                keys, counts = s.keys(s.firsts())
                used, at = X.edges(keys, buckets)
                short, cuts = keys.astype(np.uint32), list(zip(at[:-1].tolist(), at[1:].tolist()))
                cols = [used, [row["chunk"]] * len(used), [short[a:b].tobytes() for a, b in cuts], [counts[a:b].tobytes() for a, b in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, X._ASK)], schema=X._ASK)

    def keep(rows: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            s = _Sets(row["lens"], unpack(row["texts"]), width)
            firsts = s.firsts()
            keys, _ = s.keys(firsts)
            used, at = X.edges(keys, buckets)
            place = {b: i for i, b in enumerate(used.tolist())}
            grades = np.zeros(len(keys), np.uint8)
            for bucket, blob in zip(found["bucket"].to_pylist(), found["bits"].to_pylist()):
                grades[at[place[bucket]] : at[place[bucket] + 1]] = np.frombuffer(blob, np.uint8)
            tokens, prefix = [None] * len(s.sizes), [None] * len(s.sizes)
            for i in firsts.tolist():
                own = s.values[s.at[i] : s.at[i + 1]]
                grade = grades[np.searchsorted(keys, own)]
                spare = may_miss(len(own), percent) - int((grade == 0).sum())
                if spare >= 0:
                    shared = grade > 0
                    own, grade = own[shared], grade[shared]
                    tokens[i] = own.tobytes()
                    prefix[i] = own[np.lexsort((own, grade))[: spare + 1]].tobytes()
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((row["ids"], s.sizes, s.sigs, tokens, prefix), _SETS)], schema=_SETS))
        return pa.Table.from_batches(out, schema=_SETS)

    grades = _frequencies(chunks.mapInArrow(ask, X.ASK_SCHEMA))
    sets = written(chunks.groupBy("chunk").cogroup(grades.groupBy("chunk")).applyInArrow(keep, SETS_SCHEMA), "sets")
    discard(chunks)
    return sets


def _prefix_rows(sets: DataFrame) -> DataFrame:
    def explode(batches):
        for batch in batches:
            for sig, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = np.frombuffer(prefix, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([sig] * len(p), pa.binary())], names=["token", "sig"])

    return sets.select("sig", "prefix").mapInArrow(explode, "token long, sig binary")


def _segments(blocks: DataFrame, fragments: int) -> DataFrame:
    """Cut each set by the shingle order (the order of the hashes) into fragments of equal range."""
    schema = "block string, left boolean, right boolean, sig binary, n long, total long, fragment int, segment binary"
    arrow = pa.schema([("block", pa.string()), ("left", pa.bool_()), ("right", pa.bool_()), ("sig", pa.binary()), ("n", pa.int64()), ("total", pa.int64()), ("fragment", pa.int32()), ("segment", pa.binary())])
    limits = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = np.frombuffer(row["tokens"], np.uint64)
                head = {k: row[k] for k in ("block", "left", "right", "sig", "n")} | {"total": len(t)}
                parts = np.split(t, np.searchsorted(t, limits))
                yield pa.RecordBatch.from_pylist([head | {"fragment": i, "segment": p.tobytes()} for i, p in enumerate(parts)], schema=arrow)

    return blocks.mapInArrow(cut, schema)


def _partial(percent: int):
    """Common shingles, within one fragment, of the pairs of one block that can still reach the threshold."""

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("sig")
        segments = [np.frombuffer(b, np.uint64) for b in rows["segment"].to_pylist()]
        n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
        left, right = rows["left"].to_numpy(zero_copy_only=False), rows["right"].to_numpy(zero_copy_only=False)
        size = np.array([len(s) for s in segments])
        values = np.concatenate(segments)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.argsort(values, kind="stable")
        token = np.cumsum(np.concatenate(([True], values[order][1:] != values[order][:-1]))) - 1 if len(values) else order
        holders = doc[order]  # by token, then by document
        first = np.searchsorted(token, np.arange(len(token) and token[-1] + 2))
        mine = np.empty(len(values), np.int64)
        mine[order] = token
        at = np.concatenate(([0], np.cumsum(size)))
        xs, ys, shared = [], [], []
        for x in np.flatnonzero(size > 0).tolist():
            t = mine[at[x] : at[x + 1]]
            a, b = first[t], first[t + 1]
            m = b - a
            if m.sum() == len(t):
                continue
            place = np.arange(m.sum()) + np.repeat(a - np.cumsum(m) + m, m)
            common = np.bincount(holders[place], minlength=len(size))
            y = np.flatnonzero(common[x + 1 :]) + x + 1
            y = y[(left[x] & right[y]) | (right[x] & left[y])]
            c = common[y]
            need = least_shared(n[x] + 0 * y, n[y], percent)
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (size[x] - c <= total[x] - need) & (size[y] - c <= total[y] - need)
            if ok.any():
                xs.append(np.full(ok.sum(), x, np.uint32))
                ys.append(y[ok].astype(np.uint32))
                shared.append(np.minimum(c[ok], 2**32 - 1).astype(np.uint32))
        joined = [np.concatenate(v).tobytes() if v else b"" for v in (xs, ys, shared)]
        head = [b"".join(rows["sig"].to_pylist()), n.tobytes()]
        cols = [rows["block"][:1], rows["fragment"][:1], *[pa.array([b], pa.binary()) for b in (*head, *joined)]]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=_PARTIAL)

    return count


def _total(percent: int):
    """Sum the fragments' counts per pair; links become a star per component of the block, with each set's degree."""

    def add(rows: pa.Table) -> pa.Table:
        sigs, n = rows["sigs"][0].as_py(), np.frombuffer(rows["sizes"][0].as_py(), np.int64)
        x, y = (np.concatenate([np.frombuffer(b, np.uint32) for b in rows[c].to_pylist()]).astype(np.int64) for c in "xy")
        c = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["shared"].to_pylist()])
        pair, where = np.unique(x * len(n) + y, return_inverse=True)
        total = np.bincount(where, weights=c, minlength=len(pair)).astype(np.int64)
        x, y = pair // len(n), pair % len(n)
        ok = total >= least_shared(n[x], n[y], percent)
        x, y = x[ok], y[ok]
        links = np.bincount(np.concatenate((x, y)), minlength=len(n))
        root = np.arange(len(n))
        while len(x):
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (root == before).all():
                break
        used = np.flatnonzero(links).tolist()
        cols = [[sigs[16 * i : 16 * i + 16] for i in used], [sigs[16 * r : 16 * r + 16] for r in root[used].tolist()], links[used]]
        return pa.table([pa.array(v, f.type) for v, f in zip(cols, _LINK)], schema=_LINK)

    return add


def _blocks(groups: DataFrame, alive: DataFrame, percent: int, block: int, shingles: int) -> DataFrame:
    """(sig, block, left, right): which sets meet in which blocks, and on which side.

    A candidate group within both bounds is one block; small groups share one. A larger group is cut into bands of set
    sizes, such that partners are in one band or in neighbouring ones, and each band by hash into parts within half of
    the bounds; a block is a pair of parts of one band, or of neighbouring bands. A set of more shingles is a part alone.
    """
    width = F.octet_length("tokens") / 8
    sized = groups.withColumnRenamed("node", "sig").join(alive.select("sig", "n", width.alias("width")), "sig")
    sized = written(sized.withColumn("band", F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-9)))), "sized")
    total = sized.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("width").alias("all"))
    total = total.withColumn("small", (F.col("size") <= block) & (F.col("all") <= shingles)).select("component", "small")
    n, width = sized.agg(F.count(F.lit(1)), F.sum("width")).first()
    batches = max(1, -(-n * 2 // block), int(2 * (width or 0) // shingles))
    sized = spread_join(sized, total, ["component"], ["sig"], total=n)
    small = sized.where("small").select("sig", F.pmod(F.xxhash64("component"), F.lit(batches)).cast("string").alias("block"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    large = sized.where("NOT small")
    parts = F.ceil(F.greatest(2 * F.count(F.lit(1)) / block, 2 * F.sum("width") / shingles)).cast("int")
    bands = large.groupBy("component", "band").agg(parts.alias("parts"))
    above = bands.select("component", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = bands.select("component", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    bands = bands.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left").fillna(0)
    large = spread_join(large, bands, ["component", "band"], ["sig"], total=n).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))

    def met(many, name, left, right):
        """One entry for each part k of `many` that this set's part meets."""
        upto = F.when(F.col(many) > 0, F.sequence(F.lit(0), F.col(many) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(upto, lambda k: F.struct(F.concat_ws("-", F.hex("component"), *[c.cast("string") for c in name(k)]).alias("block"), left(k).alias("left"), right(k).alias("right")))

    band, part, yes, no = F.col("band"), F.col("part"), lambda k: F.lit(True), lambda k: F.lit(False)
    own = met("parts", lambda k: (band, F.least(part, k), F.greatest(part, k)), lambda k: part <= k, lambda k: part >= k)
    up = met("above", lambda k: (band, F.lit("up"), part, k), yes, no)
    down = met("below", lambda k: (band - 1, F.lit("up"), k, part), no, yes)
    return small.unionByName(large.select("sig", F.explode(F.concat(own, up, down)).alias("at")).select("sig", "at.*"))


def set_links(sets: DataFrame, percent: int, fragments: int = 4, block: int = 2048, shingles: int = 4_000_000) -> DataFrame:
    """(a, b, links): every set with a partner, a set of its component within a block, and how many links it has there.

    Candidates are sets connected by a shared prefix shingle; they are dealt to blocks of at most `block` sets and
    `shingles` shingles (see _blocks). Each block's sets are cut into fragments of the shingle order; a task counts one
    fragment of one block, dropping pairs that already lack too many shingles there, and another sums the fragments per
    pair. No pair leaves its block. Empty sets and sets without tokens have no partner.
    """
    alive = sets.where(F.col("tokens").isNotNull()).dropDuplicates(["sig", "n"])
    alive = written(alive.select("sig", "n", "tokens", "prefix"), "alive")
    prefix = written(_prefix_rows(alive), "prefix")
    leader = prefix.groupBy("token").agg(F.min("sig").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leader = written(leader, "leaders")
    linked = spread_join(prefix, leader.select("token", "b"), ["token"], ["sig"], counts=leader.select("token", "n"))
    groups = written(components(linked.select(F.col("sig").alias("a"), "b")), "groups")
    placed = _blocks(groups, alive, percent, block, shingles)
    blocks = alive.select("sig", "n", "tokens").join(placed, "sig")
    partial = _segments(blocks, fragments).groupBy("block", "fragment").applyInArrow(_partial(percent), PARTIAL_SCHEMA)
    links = written(partial.groupBy("block").applyInArrow(_total(percent), LINK_SCHEMA), "links")
    discard(alive, prefix, leader, groups)
    return links


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Which documents are linked, directly or through others, by 100 * |common| >= percent * |union| of their sets.

    A document's set: its distinct shingles of `width` words (runs without ASCII white space, A-Z lower-cased); with
    fewer words, the whole sequence as one; without words, empty and linked with nothing. Documents of equal sets are
    one class and linked. Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable, itself included), class_size, and links (partner classes of its class). Shingles are 64-bit hashes.

    docs needs doc_id and text; other columns are ignored. Null text counts as empty. Null doc_ids take part and have
    their component's smallest other doc_id, null if there is none. Repeated rows are of one class. An empty table
    gives an empty result.
    """
    sets = shingle_sets(docs, width, percent)
    star = set_links(sets, percent)
    member = components(star)
    degree = star.groupBy("a").agg(F.sum("links").alias("links"))
    classes = sets.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"))
    member = member.select(F.col("node").alias("sig"), "component")
    known = written(classes.join(member, "sig"), "known")
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = spread_join(known, lowest, ["component"], ["sig"])
    linked = linked.join(degree, F.col("sig") == F.col("a"), "left").select("sig", "n", "component_id", "links", "class_size")
    copies = classes.join(member, "sig", "left_anti").where("class_size > 1").select("sig", "n", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("links"), "class_size")
    labels = linked.unionByName(copies).drop("n")
    own = spread_join(sets.select("doc_id", "n", "sig"), labels, ["sig"], ["doc_id"], "left")
    return own.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents stays: that with the smallest doc_id; all columns are kept.

    Rows are told apart by a 64-bit hash of doc_id and text, so a doc_id may occur with different texts. Null doc_ids
    come last; of rows with the same doc_id the smallest hash stays, of rows with the same doc_id and text the smallest
    by its columns in their order. Rows without words are linked with nothing and all stay. An empty table gives an
    empty result; docs' columns may have any names.
    """
    row = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text"))
    linked = similar(docs.select(row.alias("doc_id"), "text"), width, percent).where("n_shingles > 0 AND (class_size > 1 OR links > 0)")
    linked = written(linked.groupBy(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).agg(F.count(F.lit(1)).alias("rows")), "linked")
    member = docs.select(F.col("doc_id").cast("long").alias("id"), row.alias("row")).distinct().join(linked, "row")
    first = member.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias("first"))
    judged = spread_join(linked, first, ["group"], ["row"]).select("row", "rows", (F.col("row") == F.col("first")).alias("stays"))
    judged = written(judged, "judged")
    discard(linked)
    mine = boxed(docs, row=row)
    once = mine.join(judged.where("NOT stays OR rows > 1").select("row"), "row", "left_anti").select("doc.*")
    if judged.where("stays AND rows > 1").isEmpty():
        return once
    repeats = mine.join(judged.where("stays AND rows > 1").select("row"), "row", "left_semi").groupBy("row").agg(F.min("doc").alias("doc"))
    return once.unionByName(repeats.select("doc.*"))
