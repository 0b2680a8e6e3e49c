"""Exact dedup with an extendible-hash index on shared files; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, partitions, spread_join, written

_SCALE = "100000000000000000000"  # 10**20: above every rank of a doc_id
_TOP = "9223372036854775808"


def normalised(text):
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _points(text):
    return F.length(F.coalesce(text, F.lit("")))


def _digest(text):
    return F.sha2(normalised(text), 256)


@dataclass
class Index:
    """Extendible hashing: the first `depth` bits of an address are its cell, the directory names the cell's bucket, and
    a bucket holds the chain of texts of each of its addresses."""

    depth: int
    directory: DataFrame  # cell, bucket (its first cell), local_depth
    entries: DataFrame  # bucket, address, slot (place in the address's chain), sha, keep_id, keep_points, size
    address: Callable[[Column], Column] = F.xxhash64


def _cell(address, depth: int):
    """The address's leading bits as 0 .. 2**depth - 1."""
    return F.shiftrightunsigned(address, 64 - depth) if depth else F.lit(0).cast("long")


def routed(rows: DataFrame, depth: int, directory: DataFrame) -> DataFrame:
    """rows with the bucket that the directory names for their address; null where it names none."""
    cells = directory.select(F.col("cell").alias("_cell"), "bucket")
    return rows.withColumn("_cell", _cell(F.col("address"), depth)).join(cells, "_cell", "left").drop("_cell")


def build_directory(addresses: DataFrame, capacity: int, max_doublings: int) -> tuple[int, DataFrame]:
    """(depth, directory) for a table of distinct addresses.

    It starts with one cell per `capacity` addresses. While a bucket is overfull the directory doubles and only that
    bucket splits on the next bit; after max_doublings an overfull one stays as it is (equal bits cannot be split).
    """
    depth = first = max(0, (max(addresses.count(), 1) // capacity).bit_length() - 1)
    open_cells, closed = addresses, []
    while True:
        counts = open_cells.groupBy(_cell(F.col("address"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts.withColumn("local_depth", F.lit(depth)), f"depth{depth}")
        over = counts.where(F.col("n") > capacity)
        if depth - first >= max_doublings or over.isEmpty():
            closed.append(counts)
            break
        closed.append(counts.where(F.col("n") <= capacity))
        open_cells = open_cells.join(over.select(F.col("cell").alias("at")), _cell(F.col("address"), depth) == F.col("at"), "left_semi")
        depth += 1
    directory = None
    for part in closed:  # a bucket of lower local depth is pointed to by several cells
        cells = part.select("local_depth", F.expr(f"sequence(shiftleft(cell, {depth} - local_depth), shiftleft(cell + 1, {depth} - local_depth) - 1)").alias("cells"))
        cells = cells.select(F.explode("cells").alias("cell"), F.element_at("cells", 1).alias("bucket"), "local_depth")
        directory = cells if directory is None else directory.unionByName(cells)
    return depth, written(directory, "directory")


def insert(docs: DataFrame, depth: int, directory: DataFrame, address: Callable[[Column], Column], lanes: int = 4) -> DataFrame:
    """The index's entries: every text is sent to the bucket that the directory names, and its owner, a task for a range
    of buckets, groups the texts of each address by their bytes into a chain.

    Before that, copies are combined per (address, text, lane), lanes by a hash of the doc_id: each task sends a text of
    a lane once, so an owner gets a text `lanes` times at most, however many copies it has.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _points(F.col("text")).alias("n_points"), normalised(F.col("text")).alias("body"))
    # the row that stays has the most code points, then the smallest doc_id (null last): one sortable number
    rank = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    best = (F.col("n_points").cast("decimal(10,0)") * F.lit(_SCALE).cast("decimal(21,0)") + rank).cast("decimal(36,0)")
    texts = body.select(address(F.col("body")).alias("address"), "body", F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).alias("lane"), best.alias("best"))
    texts = texts.groupBy("address", "body", "lane").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("size")).drop("lane")
    owned = routed(texts, depth, directory).where("bucket IS NOT NULL").repartitionByRange(partitions(docs.sparkSession), "bucket")
    groups = owned.groupBy("bucket", "address", "body").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    chain = Window.partitionBy("bucket", "address").orderBy("body")
    rank = F.expr(f"best % CAST('{_SCALE}' AS DECIMAL(21,0))").cast("decimal(20,0)")
    return groups.select(
        "bucket",
        "address",
        F.row_number().over(chain).alias("slot"),
        F.sha2("body", 256).alias("sha"),
        F.when(rank == 0, None).otherwise((F.lit(_TOP).cast("decimal(20,0)") - rank).cast("long")).alias("keep_id"),
        F.expr(f"CAST(best DIV CAST('{_SCALE}' AS DECIMAL(21,0)) AS INT)").alias("keep_points"),
        "size",
    )


def keyed(docs: DataFrame, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, n_points, address and digest of every row, written: what rows carry to the index."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _points(F.col("text")).alias("n_points"), normalised(F.col("text")).alias("body"))
    return written(body.select("doc_id", "n_points", address(F.col("body")).alias("address"), F.sha2("body", 256).alias("sha")), "rows")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = 2048, max_doublings: int = 8, address: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Directory and entries, written to the shared folder; rows are keyed(docs)."""
    addresses = written(rows.select("address").distinct(), "addresses")
    depth, directory = build_directory(addresses, capacity, max_doublings)
    return Index(depth, directory, written(insert(docs, depth, directory, address), "index"), address)


def probe(rows: DataFrame, index: Index) -> DataFrame:
    """Look keyed rows up: by their address to the bucket that the directory names, and there along the address's chain
    to the entry with their digest. Gives doc_id, n_points, sha, n (how often the row occurs) and the entry's columns,
    null where that bucket lacks the text."""
    alike = routed(rows.groupBy("doc_id", "n_points", "address", "sha").agg(F.count(F.lit(1)).alias("n")), index.depth, index.directory)
    counts = index.entries.select("bucket", "address", "sha", F.col("size").alias("n"))  # a text's rows are at most its size
    on = ["bucket", "address", "sha"]
    return spread_join(alike, index.entries, on, ["doc_id", "n_points"], "left", rows.count(), counts)


def _stays():
    return F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")), F.lit(False))


def exact_copies(docs: DataFrame, capacity: int = 2048, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Which documents are equal after deleting ASCII white space, and which one of each group stays.

    Of equal texts the row with the most code points in the original text, then the smallest doc_id, stays. Returns
    one row per input row, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).
    docs needs doc_id and text; other columns are ignored. Null and empty texts are equal to each other. A null doc_id
    loses ties against any other; keep_id is null if only such rows hold the text. Of rows that repeat doc_id and
    text exactly one is kept. An empty table gives an empty result. address is the hash; texts that it takes to one
    address hang in one chain.
    """
    rows = keyed(docs, address)
    found = probe(rows, build_index(docs, rows, capacity, address=address))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = _stays() & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int = 2048, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Which ones stay is said at exact_copies. Of rows that repeat doc_id and text the smallest by its columns in their
    order stays. An empty table gives an empty result.
    """
    rows = keyed(docs, address)
    kept = written(probe(rows, build_index(docs, rows, capacity, address=address)).where(_stays()).select("doc_id", "n_points", "sha", "n"), "kept")
    mine = boxed(docs, id=F.col("doc_id").cast("long"), points=_points(F.col("text")), digest=_digest(F.col("text")))
    on = (F.col("digest") == F.col("sha")) & (F.col("points") == F.col("n_points")) & F.col("id").eqNullSafe(F.col("doc_id"))
    single = mine.join(kept.where("n = 1"), on, "left_semi").select("doc.*")
    if kept.where("n > 1").isEmpty():
        return single
    several = mine.join(kept.where("n > 1"), on, "left_semi").groupBy("id", "points", "digest").agg(F.min("doc").alias("doc"))
    return single.unionByName(several.select("doc.*"))
