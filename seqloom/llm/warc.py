"""WARC archives: writing pages with segmented, chunked responses and revisits, and reading them back by reassembly.

Writing: records with equal payloads of at least min_bytes are one group (by SHA-1 and length); the largest page_id of a
group is a response, the others are revisits that refer to it. A response's HTTP message is framed in chunks; one longer than
SEGMENT bytes is split into a first record and continuation records, which carry the first one's id and their number.
Each attempt of a task writes gzip archives of about ARCHIVE bytes into the shared folder under names of its own, and the table
of archives lists those of the attempts that count: files of lost attempts are never read. Equal payloads find their response
by a join in which each group is dealt over SALT tasks.

Reading: whole records are decoded where they are parsed. Segments are grouped by their origin's id, put in order by
number, joined, held against the total length that the last one states and the digest, and freed of chunk framing. A group
is one record's segments. A record with a missing or repeated segment, a wrong length or digest is returned with intact
false, as is a revisit without a digest or a page that it refers to.

Null html is the empty payload; null url an empty URI. Rows with null page_id are responses. Repeated rows are written and
read as often as they occur; those with the group's largest page_id are all responses. Empty tables give empty results.
Extra columns are ignored. Archives are reached by pyarrow's file systems (file, hdfs, s3, gs) on executors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path

SEGMENT, CHUNK, ARCHIVE, SALT = 16_384, 8_192, 8 << 20, 16
DATE = "2024-01-01T00:00:00Z"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary, origin string, number long, total long, block binary"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        c = payload[at : at + size]
        out += [b"%x\r\n" % len(c), c, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Chunk extensions and trailers are skipped; ValueError if it ends early."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if len(body) < at + n + 2:
            raise ValueError("chunk ends early")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    clean = ((k, str(v).replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields.items() if v is not None)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def response(name: str, url: str, payload: bytes, sha: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one response: one, or a first and its continuations."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = {"WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http;msgtype=response"}
    if len(block) <= segment:
        return [record({"WARC-Type": "response"} | head, block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record({"WARC-Type": "response"} | head | {"WARC-Segment-Number": 1}, parts[0])]
    for k, p in enumerate(parts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{k}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k}
        out.append(record(own | {"WARC-Segment-Total-Length": len(block) if k == len(parts) else None}, p))
    return out


def revisit(name: str, url: str, size: int, sha: str, refers_to: int) -> bytes:
    head = {"WARC-Type": "revisit", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type": "application/http;msgtype=response"}
    return record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size)


def _write(path: str, archive: int):
    write = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        pid, part, made, buffer, size, i = task.partitionId(), 0, [], [], 0, 0
        own = f"{write}-{task.taskAttemptId()}"  # ids are of one attempt of one write

        def close():
            nonlocal part, size
            if buffer:
                name = f"part-{pid:06d}-{part:06d}-{task.taskAttemptId()}.warc.gz"
                with where.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(b"".join(buffer))
                made.append(f"{path.rstrip('/')}/{name}")
                buffer.clear()
                part, size = part + 1, 0

        for b in batches:
            for page, url, html, winner in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist()):
                payload = html.as_py() or b""
                sha, name = digest(payload), f"urn:page:{page}:{own}-{i}"
                records = [revisit(name, url or "", len(payload), sha, winner)] if winner is not None else response(name, url or "", payload, sha)
                i += 1
                for r in records:  # a segment may go to the next archive
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    buffer.append(z.compress(r) + z.flush())
                    size += len(buffer[-1])
                    if size >= archive:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """Write pages into path; the table of archives. winner is the page that a revisit refers to, null for a response."""
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = pages.select(F.col("page_id").cast("long"), "url", "html").withColumns({"_sha": F.unhex(F.sha1(body)), "_n": F.octet_length(F.coalesce("html", F.lit("")))})
    best = d.groupBy("_sha", "_n").agg(F.max("page_id").alias("_best"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    best = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    d = d.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(SALT)), F.lit(0)).cast("int")).join(best, ["_sha", "_n", "_salt"], "left")
    winner = F.when((F.col("_best") != F.col("page_id")) & (F.col("_n") >= min_bytes), F.col("_best"))
    return cut(d.select("page_id", "url", "html", winner.alias("winner")).mapInArrow(_write(path, archive), "path string"), "warc-files")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        at = end + 4 + int(head["content-length"])
        yield head, data[end + 4 : at]
        at += 4


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, sha: str, total: int | None, whole: bool = True) -> tuple[bytes, bool]:
    try:
        payload = decoded(block)
    except ValueError:
        return b"", False
    return payload, whole and (total is None or total == len(block)) and digest(payload) == sha


def _page(name: str) -> int | None:
    n = name.strip("<>").split(":")[2]
    return None if n == "None" else int(n)


def _parse(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())).read()):
                    kind, name, sha = h["warc-type"], h["warc-record-id"], h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        n = int(block.lower().partition(b"content-length: ")[2].partition(b"\r\n")[0])
                        to = _page(h.get("warc-refers-to", "<urn:page:None>"))
                        rows.append((_page(name), n, sha, kind, to, bool(sha) and to is not None, None, None, None, None, None))
                    elif "warc-segment-number" in h:
                        total = h.get("warc-segment-total-length")
                        rows.append((_page(name), None, sha, kind, None, None, None, h.get("warc-segment-origin-id", name), int(h["warc-segment-number"]), total and int(total), block))
                    else:
                        payload, good = _checked(block, sha, None)
                        rows.append((_page(name), len(payload), sha, kind, None, good, payload if keep else None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _READ.split(", ")])

    return run


def _join(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for parts in b.column(0):
                parts = parts.as_py()
                last = parts[-1]
                whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and last["total"] is not None
                payload, good = _checked(b"".join(p["block"] for p in parts), parts[0]["sha"], last["total"], whole)
                rows.append((parts[0]["page"], len(payload), parts[0]["sha"], "response", None, good, payload if keep else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _READ.split(", ")[:7]])

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in b.column(0).to_pylist():
            where, name = fs.FileSystem.from_uri(p)
            with where.open_input_stream(name, compression=None) as f:
                yield pa.RecordBatch.from_arrays([pa.array([f.read()], pa.binary())], ["content"])


def read_archives(spark: SparkSession, files: DataFrame | str, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact and, if asked for, payload of each record.

    files is the table that write_archives() returned, or a folder of foreign archives, of which all are read."""
    if isinstance(files, str):
        files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.gz").load(files).select("content")
    else:
        files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_open, "content binary")
    read = cut(files.mapInArrow(_parse(payloads), _READ), "warc-records")
    columns = [c.split()[0] for c in _READ.split(", ")[:7]]
    parts = read.where("number is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", F.col("payload_digest").alias("sha"), F.col("page_id").alias("page"), "block"))).alias("parts"))
    joined = parts.select("parts").mapInArrow(_join(payloads), ", ".join(_READ.split(", ")[:7]))
    return read.where("number is null").select(columns).union(joined).select(columns if payloads else columns[:6])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, path), payloads=False)
