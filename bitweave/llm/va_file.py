"""Exact top-k inner-product search with vector-approximation files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, partitions, written

BLOCK_SCHEMA = "block long, dims int, n int, codes binary, edges binary, vectors array<array<long>>, members array<array<long>>"
_LISTS = pa.list_(pa.list_(pa.int64()))
_BLOCK = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), ("codes", pa.binary()), ("edges", pa.binary()), ("vectors", _LISTS), ("members", _LISTS)])
QUERY_SCHEMA = "group long, dims int, ids array<long>, ranks array<int>, wanted array<array<long>>"
_QUERY = pa.schema([("group", pa.int64()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("wanted", _LISTS)])
FLOOR_SCHEMA = "group long, floors binary"
_FLOOR = pa.schema([("group", pa.int64()), ("floors", pa.binary())])
FOUND_SCHEMA = "group long, query int, block long, place int, bound long"
_FOUND = pa.schema([("group", pa.int64()), ("query", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("bound", pa.int64())])
LEAST = np.iinfo(np.int64).min
DEEPEST = 64  # own vectors of a query's id that its floor can allow for; with more it has none


def whole_numbers(embedding, scale: int = 256):
    """floor(scale * x) of each component as double; null for a vector that is null or holds null or non-finite ones."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _rows(column, dims: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(len(column), dims)


def _by_dims(batch, at: int):
    """(dims, row numbers) of a batch whose column `at` holds the vectors."""
    lens = np.array([len(v) for v in batch.column(at)])
    for dims in np.unique(lens).tolist():
        yield dims, np.flatnonzero(lens == dims)


def cells(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per dimension, 2**bits cells of equal whole-number width over the block's range: codes, and (low, width)."""
    low = vectors.min(axis=0)
    width = (vectors.max(axis=0) - low) // (1 << bits) + 1
    return ((vectors - low) // width).astype(np.uint8), np.stack((low, width))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by float64 where that is exact, else by int64, which wraps like BIGINT."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**52 else a @ b.T


def bounds(wanted: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any vector of each cell."""
    low = edges[0] + codes.astype(np.int64) * edges[1]
    high = low + edges[1] - 1
    plus, minus = np.maximum(wanted, 0), np.minimum(wanted, 0)
    return product(plus, low) + product(minus, high), product(plus, high) + product(minus, low)


def build(vectors: DataFrame, k: int, bits: int, block: int) -> DataFrame:
    """The file's blocks of distinct vectors: cell codes and cell edges, and in columns of their own the exact vectors,
    each with its smallest ids: k occurrences of an id at most, and 2k in all. A query leaves out one id, so its k
    results are among them, however many copies there are."""
    ids = vectors.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = ids.withColumn("nth", nth).where(F.col("nth") <= 2 * k)
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    distinct = few.groupBy("v").agg(F.slice(each, 1, 2 * k).alias("ids"))

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for dims, rows in _by_dims(batch, 0):
                for i in range(0, len(rows), block):
                    some = batch.take(pa.array(rows[i : i + block]))
                    v = _rows(some.column(0), dims)
                    codes, edges = cells(v, bits) if dims else (np.zeros((len(v), 0), np.uint8), np.zeros((2, 0), np.int64))
                    row = {"block": part << 32 | seq, "dims": dims, "n": len(v), "codes": codes.tobytes(), "edges": edges.tobytes(), "vectors": some.column(0).to_pylist(), "members": some.column(1).to_pylist()}
                    yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)
                    seq += 1

    return written(distinct.select("v", "ids").mapInArrow(pack, BLOCK_SCHEMA), "vectors")


def _query_groups(queries: DataFrame, vectors: DataFrame, k: int, size: int) -> DataFrame:
    """Queries in groups of one length. A query's floor is its (k + own)th greatest lower bound, own being the number of
    different vectors with the query's id; 0 stands for no floor."""
    own = vectors.select("vec_id", F.xxhash64("v").alias("h")).distinct().groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    rank = F.when(F.coalesce("own", F.lit(0)) <= DEEPEST, F.coalesce("own", F.lit(0)) + k).otherwise(0).cast("int")

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for dims, rows in _by_dims(batch, 2):
                for i in range(0, len(rows), size):
                    ids, ranks, v = (c.to_pylist() for c in batch.take(pa.array(rows[i : i + size])).columns)
                    yield pa.RecordBatch.from_pylist([{"group": part << 32 | seq, "dims": dims, "ids": ids, "ranks": ranks, "wanted": v}], schema=_QUERY)
                    seq += 1

    return written(queries.join(own, "vec_id", "left").select("vec_id", rank.alias("rank"), "v").mapInArrow(pack, QUERY_SCHEMA), "queries")


def _wanted(row: dict) -> np.ndarray:
    return np.array(row["wanted"], np.int64).reshape(len(row["ids"]), row["dims"])


def _cells_of(rows: pa.Table):
    """(block number, codes, edges) of each block."""
    for r in rows.to_pylist():
        yield r["block"], r["dims"], np.frombuffer(r["codes"], np.uint8).reshape(r["n"], r["dims"]), np.frombuffer(r["edges"], np.int64).reshape(2, r["dims"])


def _floors(blocks: pa.Table, groups: pa.Table) -> pa.Table:
    """Per group of queries, the greatest lower bounds in these blocks, as many as the group's deepest floor needs."""
    out, cells_ = [], list(_cells_of(blocks))
    for r in groups.to_pylist():
        depth = max(r["ranks"])
        if not depth:
            continue
        q = _wanted(r)
        best = np.full((len(q), depth), LEAST)
        for _, dims, codes, edges in cells_:
            if dims == r["dims"]:
                best = np.concatenate((best, bounds(q, codes, edges)[0]), axis=1)
                best = np.partition(best, best.shape[1] - depth, axis=1)[:, -depth:]
        out.append({"group": r["group"], "floors": best.tobytes()})
    return pa.Table.from_pylist(out, schema=_FLOOR)


def _settle(floors: pa.Table, groups: pa.Table) -> pa.Table:
    """Each query's floor over all blocks."""
    r = groups.to_pylist()[0]
    ranks = np.array(r["ranks"])
    depth = max(int(ranks.max()), 1)
    all_ = [np.full((len(ranks), depth), LEAST), *(np.frombuffer(b, np.int64).reshape(len(ranks), depth) for b in floors["floors"].to_pylist())]
    best = np.sort(np.concatenate(all_, axis=1), axis=1)[:, ::-1]
    floor = np.where(ranks > 0, best[np.arange(len(ranks)), np.maximum(ranks, 1) - 1], LEAST)
    return pa.Table.from_pylist([{"group": r["group"], "floors": floor.tobytes()}], schema=_FLOOR)


def _candidates(blocks: pa.Table, groups: pa.Table) -> pa.Table:
    """The cells whose upper bound reaches a query's floor."""
    parts, cells_ = [], list(_cells_of(blocks))
    for r in groups.to_pylist():
        q, floor = _wanted(r), np.frombuffer(r["floors"], np.int64)
        for block, dims, codes, edges in cells_:
            if dims == r["dims"]:
                high = bounds(q, codes, edges)[1]
                query, place = np.nonzero(high >= floor[:, None])
                n = len(query)
                cols = [np.full(n, r["group"]), query.astype(np.int32), np.full(n, block), place.astype(np.int32), high[query, place]]
                parts.append(pa.table([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND))
    return pa.concat_tables(parts) if parts else _FOUND.empty_table()


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, block: int = 2048, group: int = 128, first: int = 4) -> DataFrame:
    """Exact k best rows of `embeddings` for each row of `queries` by inner product of floor(256 * x) components.

    The vector-approximation file holds, per block of vectors, `bits` bits per dimension. Batches of query groups meet
    lanes of blocks (a stated query set against all rows, in blocks): a first scan of the cells gives each query its
    floor, the greatest lower bounds over all blocks; a second one the cells whose upper bound reaches it. Their exact
    vectors are read in rounds, in descending order of the bounds, `first` * k at first and four times as many in each
    later round, for as long as a query's next bound reaches its kth score.

    Both frames need vec_id and embedding; other columns are ignored. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller vec_id; fewer than k if there are fewer. Rows with the query's vec_id are no candidates.
    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; vectors of
    another length are no candidates; vectors of length 0 have score 0. Repeated query rows are answered once; a repeated
    candidate row is one candidate per occurrence. No queries or no candidates give an empty result.
    """
    n = partitions(embeddings.sparkSession)
    vectors, wanted = (d.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL") for d in (embeddings, queries))
    stored = build(vectors, k, bits, block)
    asked = _query_groups(wanted.distinct(), vectors, k, group)
    blocks = stored.count()
    lanes, batches = max(1, min(blocks, n), -(-blocks // 16)), max(1, -(-asked.count() // 8))
    lane, batch = F.pmod(F.xxhash64("block"), F.lit(lanes)), F.pmod(F.xxhash64("group"), F.lit(batches))
    approximations = stored.select("block", "dims", "n", "codes", "edges", lane.alias("lane"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"))

    def meet(groups, function, schema):
        groups = groups.select("*", batch.alias("batch"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
        return approximations.groupBy("lane", "batch").cogroup(groups.groupBy("lane", "batch")).applyInArrow(function, schema)

    floors = written(meet(asked, _floors, FLOOR_SCHEMA).groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(_settle, FLOOR_SCHEMA), "floors")
    found = written(meet(asked.join(floors, "group"), _candidates, FOUND_SCHEMA), "candidates")
    order = F.row_number().over(Window.partitionBy("group", "query").orderBy(F.col("bound").desc(), "block", "place"))
    exact = stored.select("block", F.posexplode(F.arrays_zip("vectors", "members")).alias("place", "x")).select("block", "place", F.col("x.vectors").alias("v"), F.col("x.members").alias("members"))
    single = asked.select("group", F.posexplode(F.arrays_zip("ids", "wanted")).alias("query", "x")).select("group", "query", F.col("x.ids").alias("query_id"), F.col("x.wanted").alias("w"))
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    best, done, upto, open_ = None, 0, first * k, None
    while True:
        # the first candidates of each open query, cut in every task before they meet
        some = found if open_ is None else found.join(open_, ["group", "query"], "left_semi")
        some = written(some.withColumn("turn", order).where(F.col("turn") <= upto + 1), "turns")
        turn = some.where(f"turn > {done} AND turn <= {upto}")
        read = turn.join(exact, ["block", "place"]).join(single, ["group", "query"])
        read = read.select("group", "query", "query_id", score.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query_id")
        every = read if best is None else best.drop("rank").unionByName(read)
        rank = F.row_number().over(Window.partitionBy("group", "query").orderBy(F.col("score").desc(), "vec_id"))
        last, best = best, written(every.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        if last is not None:
            discard(last)
        # a query is settled once its next bound is below its kth score
        kth = best.where(F.col("rank") == k).select("group", "query", F.col("score").alias("kth"))
        further = some.where(f"turn = {upto + 1}").select("group", "query", "bound").join(kth, ["group", "query"], "left")
        open_ = written(further.where("kth IS NULL OR bound >= kth").select("group", "query"), "open")
        if open_.isEmpty():
            return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        done, upto = upto, 4 * upto
