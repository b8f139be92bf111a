"""WARC archives: a writer that segments and chunks, and a reader that reassembles segments.

Written: ``response`` records whose block is an HTTP message with chunked transfer framing, and ``revisit`` records
for equal payloads. A block longer than ``segment`` bytes becomes a first record and ``continuation`` records that
name it by WARC-Segment-Origin-ID; the last of them carries WARC-Segment-Total-Length. A file's records are
compressed one by one. Read: segments are grouped by origin, ordered by number and checked against the total
length and the numbers' completeness; then the chunked framing is decoded and digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import bound_batches, stage, stage_path

SEGMENT, CHUNK, FILE = 1 << 15, 1 << 13, 32 << 20
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for a in range(0, len(payload), size):
        piece = payload[a : a + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; chunk extensions and trailers are passed over; raises on a broken frame."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it should")
        parts.append(body[at : at + n])
        at += n + 2


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    data = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, origin: int | None, row: str, segment: int = SEGMENT, named: bool = True) -> Iterator[bytes]:
    """The records of one page; ``origin``: the page that it revisits, whose record has an id known by its page if ``named``."""
    own, target = record_id(f"page:{row}"), " ".join((url or "about:blank").split()) or "about:blank"
    base = [("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload)))]
    base += [("X-Page-Id", str(page_id))] if page_id is not None else []
    if origin is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *([("WARC-Refers-To", record_id(f"page:{origin}:{digest}"))] if named else []), ("X-Refers-To-Page", str(origin))]
        yield record("revisit", [*base, *more, ("Content-Type", "application/http;msgtype=response")], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    base.append(("Content-Type", "application/http;msgtype=response"))
    if len(block) <= segment:
        yield record("response", base, block)
        return
    yield record("response", [*base, ("WARC-Segment-Number", "1")], block[:segment])
    for k, a in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Record-ID", record_id(f"page:{row}:{k}")), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", own)]
        if a + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", more, block[a : a + segment])


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file, compressed one by one or plain; one record is in memory at a time."""
    held = stream.read(1 << 16)
    packed = held[:2] == b"\x1f\x8b"
    while held:
        if packed:
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                parts.append(unpack.decompress(held))
                held = unpack.unused_data
                if not unpack.eof:
                    held = stream.read(1 << 16)
                    if not held:
                        raise EOFError("a file ends within a record")
            data = b"".join(parts)
            held = held or stream.read(1 << 16)
        else:
            while (end := held.find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 16)
                if not more:
                    raise EOFError("a file ends within a header")
                held += more
            length = next(int(x.split(b":", 1)[1]) for x in held[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
            need = end + 4 + length + 4
            if len(held) < need:
                held += stream.read(need - len(held))
            data, held = held[:need], held[need:] or stream.read(1 << 16)
        head, _, block = data.partition(b"\r\n\r\n")
        fields = {}
        for x in head.decode().split("\r\n")[1:]:
            k, _, v = x.partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, block[: int(fields["content-length"])]


def whole(name: str, total: int | None, parts: list[dict]) -> bytes:
    """Join a record's segments, sorted by number, in time linear in their bytes; raises if one is missing or the total differs."""
    if parts[0]["segment"] is None:
        return parts[0]["block"]
    blocks = {p["segment"]: p["block"] for p in parts}
    block = b"".join(blocks[k] for k in sorted(blocks))
    if sorted(blocks) != list(range(1, len(blocks) + 1)) or len(block) != total:
        raise ValueError(f"segments missing of {name}")
    return block


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, file_bytes: int = FILE, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``*.warc.gz`` under ``path``, a URI that all executors share.

    Of pages with equal payloads of at least ``min_bytes``, that with the smallest page_id becomes a response and
    the others revisit it. Null html is an empty payload; pages without an id are all responses and no page's
    origin; repeated rows of the origin's own id are all responses, too. Every record has an id of its own; a revisit
    names its origin's record by id where there is but one. Returns the written files, ``path, records``. Names hold the task's attempt, and only files of attempts that succeeded are listed: what a lost
    or late attempt leaves isn't read. Columns other than page_id, url and html aren't written.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_d", F.sha1(F.col("html").cast("binary"))).withColumn("_n", F.octet_length("html"))
    first = rows.where((F.col("_n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("_d", "_n", "page_id").agg(F.count("*").alias("_rows"))
    first = first.groupBy("_d", "_n").agg(F.min(F.struct("page_id", "_rows")).alias("_first"), F.max("page_id").alias("_last")).where("_first.page_id < _last or _first._rows > 1")
    rows = rows.join(first, ["_d", "_n"], "left").withColumn("_origin", F.when(F.col("page_id") != F.col("_first.page_id"), F.col("_first.page_id")))
    rows = rows.select("page_id", "url", F.when(F.col("_origin").isNull(), F.col("html")).alias("html"), "_d", F.col("_n").cast("long").alias("_n"), "_origin", F.coalesce(F.col("_first._rows") > 1, F.lit(False)).alias("_many"))
    schema = "path string, records long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, tries = task.partitionId(), task.taskAttemptId()
        done: list[tuple[str, int]] = []
        out, temp, size, n = None, "", 0, 0

        def close() -> None:
            nonlocal out, size, n
            if out is not None:
                out.close()
                name = f"{root}/part-{part:06d}-{tries}-{len(done):04d}.warc.gz"
                fs.move(temp, name)
                done.append((name, n))
            out, size, n = None, 0, 0

        seen = 0
        for batch in batches:
            for page_id, url, html, hexed, length, origin, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    temp = f"{root}/_{part}-{tries}-{len(done)}.tmp"
                    out = fs.open_output_stream(temp, compression=None)
                seen += 1
                payload = (html or "").encode() if origin is None else _Length(length)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                # only the one response of an origin is named by others; all else has an id by its place
                row = f"{page_id}:{digest}" if page_id is not None and origin is None and not many else f"{page_id}:{digest}:{part}:{tries}:{seen}"
                for data in records_of(page_id, url, payload, digest, origin, row, segment, not many):
                    out.write(data)
                    size, n = size + len(data), n + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return stage(rows.mapInArrow(write, schema), "warc-files")


class _Length(bytes):
    """Stands for a payload that isn't written: only its length counts."""

    def __new__(cls, n: int) -> _Length:
        self = super().__new__(cls)
        self.n = n
        return self

    def __len__(self) -> int:
        return self.n


def read_warc(files: DataFrame, uri: str) -> DataFrame:
    """Read the archives listed in ``files`` (path) on the file system of ``uri`` back into pages.

    Returns ``page_id, url, record_id, record_type, refers_to, payload_bytes, payload_digest, payload``: payload is
    the decoded body (null for a revisit, whose bytes and digest are those of the full payload it stands for).
    Raises if a segment is missing, a total length differs or a digest doesn't verify.

    Only segmented records are shuffled, by origin; a group is one record's own segments.
    """
    spark = files.sparkSession
    fields = "record_id string, page_id long, url string, record_type string, refers_to long, bytes long, digest string, segment int, total long, block binary"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for f, block in parse(stream):
                        kind, number = f["warc-type"], f.get("warc-segment-number")
                        page, to, total = f.get("x-page-id"), f.get("x-refers-to-page"), f.get("warc-segment-total-length")
                        origin = f["warc-record-id"] if kind != "continuation" else f["warc-segment-origin-id"]
                        rows.append((origin, int(page) if page else None, f.get("warc-target-uri"), kind, int(to) if to else None, int(f.get("x-payload-bytes", -1)), f.get("warc-payload-digest", "").removeprefix("sha1:"), int(number) if number else None, int(total) if total else None, block))
                        size += len(block)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism + int(spark.conf.get("spark.sql.shuffle.partitions"))))
    segments = files.select("path").repartition(n).mapInArrow(read, fields)
    alone = segments.where("segment is null").drop("segment", "total")
    part = F.struct("segment", "block")
    head = F.when(F.col("segment") == 1, F.struct("page_id", "url", "record_type", "refers_to", "bytes", "digest"))
    joined = segments.where("segment is not null").groupBy("record_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(part)).alias("s"), F.collect_list(head).alias("h"))
    # a record that comes in one piece is a list of one; each first segment is a row
    pieces = alone.select("record_id", "page_id", "url", "record_type", "refers_to", "bytes", "digest", F.lit(None).cast("long").alias("total"), F.array(F.struct(F.lit(None).cast("int").alias("segment"), "block")).alias("s"))
    records = pieces.union(joined.select("record_id", F.explode("h").alias("h"), "total", "s").select("record_id", "h.*", "total", "s"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for name, kind, size, digest, total, parts in zip(*(batch.column(k).to_pylist() for k in (0, 3, 5, 6, 7, 8)), strict=True):
                if kind == "revisit":
                    payload = None
                else:
                    head, _, body = whole(name, total, parts).partition(b"\r\n\r\n")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    size = len(payload)
                    if sha1_base32(payload) != digest:
                        raise ValueError("a payload's digest doesn't verify")
                sizes.append(size)
                digests.append(digest)
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(0), batch.column(3), batch.column(4), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())],
                ["page_id", "url", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
            )

    return records.mapInArrow(decode, "page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    path = stage_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path), path)
