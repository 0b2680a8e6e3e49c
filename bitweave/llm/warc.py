"""WARC records in ZIP packages on shared storage: writing, and reading them back by byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import re
import struct
import uuid
import zipfile
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, partitions, spread_join, written

MANIFEST_SCHEMA = "path string, records long, bytes long"
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
RANGE_SCHEMA = "path string, start long, lengths array<long>"
_RANGE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """The pyarrow file system of a Hadoop-style path, and the path there."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# --- records --------------------------------------------------------------------------------------------------


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(text: str):
    value = text.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def _target(url) -> list[str]:
    """The target's header; a url with spaces or control characters is percent-encoded there and exact in a second."""
    if url is None:
        return []
    plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return [f"WARC-Target-URI: {plain}", *([f"X-Target-URI-Exact: {json.dumps(url)}"] if plain != url else [])]


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member of its own. A revisit holds the HTTP head, not the payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *_target(url),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> dict:
    """The headers and the payload of a record, one whole gzip member."""
    try:
        raw = gzip.decompress(raw)
    except EOFError as e:
        raise ValueError("a record is cut off") from e
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return {"fields": fields, "payload": block.partition(b"\r\n\r\n")[2]}


# --- the package ----------------------------------------------------------------------------------------------


def package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP whose members are all stored: archive/data.warc.gz and its index, one JSON line per record."""
    out, at, lines = io.BytesIO(), 0, []
    for key, raw in records:
        lines.append(json.dumps({"key": key, "offset": at, "length": len(raw)}))
        at += len(raw)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in (("archive/data.warc.gz", (r for _, r in records)), ("indexes/index.jsonl", ("\n".join(lines).encode(),))):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                for part in parts:
                    member.write(part)
    return out.getvalue()


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its bytes, length) of the stored members, from the central directory alone.

    read(offset, length) reads a range. ZIP64 records are followed where a field is at its limit. A compressed or
    encrypted member raises ValueError.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # within the comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
        where = end - 20
        locator = tail[where:end] if where >= 0 else read(tail_at + where, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack("<QQQ", end64[32:56])
    central, at, out = read(offset, length), 0, {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", central[at + 8 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", central[at + 20 : at + 34])
        header = struct.unpack("<I", central[at + 42 : at + 46])[0]
        name = central[at + 46 : at + 46 + n_name].decode()
        extra, i = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[i : i + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[i + 4 : i + 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            i += 4 + n
        if method or flags & 1 or packed != plain:
            raise ValueError(f"{name} is not stored as it is")
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        out[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), plain)
        at += 46 + n_name + n_extra + n_comment
    return out


# --- Spark ----------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, revisit, refers_to of the records to write.

    Of equal payloads of at least least_bytes, the row with the largest page_id is the response and the others revisit
    it; of rows with that page_id and payload, one with the smallest url (null first). Groups are decided on ids and
    SHA-256 digests. The payloads are shuffled once, by row; rows alike in page_id, url and payload are combined before
    that, so neither a common payload nor a repeated row is a hot key.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url").isNull().cast("string"), F.coalesce("url", F.lit("")), F.hex("same"))
    rows = rows.withColumn("row", F.unhex(F.md5(name.cast("binary"))))
    narrow = rows.where(F.octet_length("payload") >= least_bytes).groupBy("row", "page_id", "url", "same").agg(F.count(F.lit(1)).alias("n"))
    narrow = written(narrow, "payloads")
    best = F.min(F.struct(F.col("page_id").isNull(), F.bitwise_not("page_id").alias("down"), "url", "row"))
    top = narrow.groupBy("same").agg(best.alias("best"), F.sum("n").alias("copies")).where("copies > 1")
    top = top.select("same", F.col("best.row").alias("first"), F.bitwise_not("best.down").alias("top"))
    judged = spread_join(narrow.select("row", "same"), top, ["same"], ["row"]).select("row", (F.col("row") == F.col("first")).alias("is_first"), "top")
    alike = rows.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload")], F.count(F.lit(1)).alias("n"))
    rows = alike.join(judged, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    revisit = F.col("is_first").isNotNull() & ~(F.col("is_first") & (F.col("copy") == 1))
    return rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = 8 << 20, least_bytes: int = 1000) -> DataFrame:
    """Write the pages as WARC packages into a shared folder; returns their manifest (path, records, bytes).

    Each task writes a package whenever its records reach archive_bytes, under a name of its own, in one piece; the
    manifest lists the files of tasks that succeeded, so a retried or lost task leaves at most an unlisted file.
    """
    folder = folder or fresh_path(pages.sparkSession, "archives")

    def write(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        held, size = [], 0

        def flush():
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            data = package(held)
            with fs.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name.rpartition('/')[2]}", "records": len(held), "bytes": len(data)}], schema=_MANIFEST)

        for batch in batches:
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"])
                held.append((_urn(r["page_id"]), raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(plan_records(pages, least_bytes).mapInArrow(write, MANIFEST_SCHEMA), "manifest")


def read_archives(manifest: DataFrame, range_bytes: int = 1 << 20) -> DataFrame:
    """Every record of the listed packages: RECORD_SCHEMA.

    Central directories and indexes are read by ranges first; then runs of whole records of about range_bytes are dealt
    out and read, each by one range, without extracting a package. Payload length and digest of a response are those of
    the bytes read (a wrong digest raises); a revisit states those of the record it refers to.
    """

    def locate(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    found = members(lambda at, n: f.read_at(n, at), f.size())
                    at, n = found["indexes/index.jsonl"]
                    index = [json.loads(line) for line in f.read_at(n, at).decode().splitlines()]
                at, lengths, size = found["archive/data.warc.gz"][0], [], 0
                for x in index:
                    if lengths and size + x["length"] > range_bytes:
                        yield pa.RecordBatch.from_pylist([{"path": path, "start": at, "lengths": lengths}], schema=_RANGE)
                        at, lengths, size = at + size, [], 0
                    lengths.append(x["length"])
                    size += x["length"]
                if lengths:
                    yield pa.RecordBatch.from_pylist([{"path": path, "start": at, "lengths": lengths}], schema=_RANGE)

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = filesystem(r["path"])
                with fs.open_input_file(name) as f:
                    raw, ends = f.read_at(sum(r["lengths"]), r["start"]), list(itertools.accumulate(r["lengths"]))
                yield pa.RecordBatch.from_pylist([_row(raw[end - n : end]) for n, end in zip(r["lengths"], ends)], schema=_RECORD)

    n = partitions(manifest.sparkSession)
    ranges = manifest.select("path").repartition(n).mapInArrow(locate, RANGE_SCHEMA)
    return ranges.repartition(n, "path", "start").mapInArrow(read, RECORD_SCHEMA)


def _row(raw: bytes) -> dict:
    found = parse(raw)
    fields, payload = found["fields"], found["payload"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"wrong digest in {fields['WARC-Record-ID']}")
    return {
        "page_id": _from_urn(fields["WARC-Record-ID"]),
        "url": json.loads(fields["X-Target-URI-Exact"]) if "X-Target-URI-Exact" in fields else fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _from_urn(fields["WARC-Refers-To"]),
        "payload": payload if response else None,
        "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
    }


def round_trip(pages: DataFrame, archive_bytes: int = 8 << 20, least_bytes: int = 1000) -> DataFrame:
    """Write all pages to packages and read every record back.

    pages needs page_id, url and html; other columns are ignored. A null html is an empty payload; null urls and
    page_ids stay null (the largest page_id of a group is then among the others; if all are null, refers_to is null).
    Rows that repeat page_id and payload: one of them can be the response, the others revisit it. An empty table gives
    an empty result.
    """
    return read_archives(write_archives(pages, None, archive_bytes, least_bytes))
