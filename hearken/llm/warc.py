"""WARC archives: written by tasks into shared storage, read back sequentially.

One gzip member per record. The reader inflates incrementally, frames a record by its Content-Length and verifies
block and payload digests while the bytes pass, so it holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DROPPED, bounded_batches, cut, scratch_path, text_or_empty
from .exact_dedup import elect

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of at least this many bytes are stored once.
LEAST_BYTES = 100
CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that is cut short, badly framed, or doesn't match its digest."""


def _one_line(s: str) -> str:
    return " ".join(s.split())


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url) if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return record_bytes(headers, block)


class MemberStream:
    """Bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, raw):
        self.raw, self.left, self.z, self.buf = raw, b"", None, b""

    def next_member(self) -> bool:
        if not self.left:
            self.left = self.raw.read(CHUNK)
        self.z, self.buf = (zlib.decompressobj(31), b"") if self.left else (None, b"")
        return bool(self.z)

    def more(self) -> bytes:
        """Some more bytes of this member; empty at its end."""
        while not self.z.eof:
            if not self.left:
                self.left = self.raw.read(CHUNK)
                if not self.left:
                    raise WarcError("archive ends inside a member")
            out = self.z.decompress(self.left, CHUNK)
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        got = bytearray(self.buf)
        while (at := got.find(mark)) < 0:
            if not (x := self.more()):
                raise WarcError("member ends inside a header")
            got += x
        self.buf = bytes(got[at + len(mark) :])
        return bytes(got[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n > 0:
            x = self.buf or self.more()
            if not x:
                raise WarcError("member ends inside a block")
            self.buf = x[n:]
            yield x[:n]
            n -= len(x[:n])


def _fields(raw: bytes) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").split(":", 1) for x in raw.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(raw, with_payload: bool = False) -> Iterator[dict]:
    """Records of one archive, in order. Raises :class:`WarcError` on bad framing or digests."""
    s = MemberStream(raw)
    while s.next_member():
        h = _fields(s.until(b"\r\n\r\n"))
        left, block, whole = int(h["content-length"]), hashlib.sha256(), hashlib.sha256()
        head, http, kept, size = bytearray(), None, [], 0
        for x in s.exactly(left):
            block.update(x)
            if http is None:
                head += x
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, x = _fields(bytes(head[:at])), bytes(head[at + 4 :])
            whole.update(x)
            size += len(x)
            if with_payload:
                kept.append(x)
        if b"".join([*s.exactly(4)]) != b"\r\n\r\n" or s.buf or s.more():
            raise WarcError("record isn't followed by its end")
        http = http or {}
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise WarcError(f"block digest of {h['warc-record-id']}")
        if h["warc-type"] == "response" and (whole.hexdigest() != digest or size != int(http["content-length"])):
            raise WarcError(f"payload digest of {h['warc-record-id']}")
        yield {
            "type": h["warc-type"],
            "id": h["warc-record-id"],
            "uri": h["warc-target-uri"],
            "refers_to": h.get("warc-refers-to"),
            "digest": digest,
            "bytes": int(http.get("content-length", size)),
            "payload": b"".join(kept) if with_payload else None,
        }


def plan_records(pages: DataFrame) -> DataFrame:
    """``_id, _sha, refers_to`` of the pages that revisit an earlier one; small rows, html is not moved."""
    rows = cut(
        pages.filter(F.octet_length(text_or_empty("html")) >= LEAST_BYTES).select(
            F.col("page_id").cast("long").alias("page_id"),
            F.sha2(text_or_empty("html").cast("binary"), 256).alias("sha"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    out = elect(rows, "sha", "page_id", largest=False).filter(~F.col("page_id").eqNullSafe(F.col("keep_id")))
    return out.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("keep_id").alias("refers_to")).distinct()


def arrow_uri(path: str) -> str:
    """A qualified Hadoop path as workers open it. Hadoop's names of S3 are those of its own clients. Workers need what the store asks for: its
    credentials where Arrow looks for them, ``libhdfs`` for ``hdfs``. Stores that only Hadoop reads raise an error."""
    return re.sub(r"^s3[an]://", "s3://", path)


def write_archives(pages: DataFrame, base: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``base``; a DataFrame of archive paths.

    Each task writes one archive under a name of its own attempt and renames it when whole, so a task that is run
    again leaves a whole archive too. Null html is an empty payload, a null page_id is written as ``None``.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")
    ).withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    plan = cut(plan_records(pages))
    # few revisits go to the pages; with many, pages meet them by a shuffle
    plan = F.broadcast(plan) if plan.count() <= DROPPED else plan.hint("shuffle_hash")
    todo = rows.join(plan, rows["page_id"].eqNullSafe(plan["_id"]) & (rows["sha"] == plan["_sha"]), "left").select(
        "page_id", "url", "html", F.when(F.col("_sha").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(arrow_uri(base))
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        part, n = f"{name}.{task.taskAttemptId()}", 0
        with fs.open_output_stream(part, compression=None) as out:
            for b in batches:
                for page_id, url, html, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    payload = html.encode()
                    out.write(page_record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), kind, refers, date))
                    n += 1
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "n": pa.array([n], pa.int64())})

    return todo.mapInArrow(write, "path string, n long")


def read_archives(archives: DataFrame, base: str, with_payload: bool = False) -> DataFrame:
    """Records of all ``archives`` (rows with a ``path``), each read sequentially in one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(arrow_uri(base))
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for r in read_records(raw, with_payload):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 300
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return archives.select("path").mapInArrow(
        read, "type string, id string, uri string, refers_to string, digest string, bytes long, payload binary"
    )


SCHEMA = pa.schema(
    [(k, pa.string()) for k in ("type", "id", "uri", "refers_to", "digest")] + [("bytes", pa.int64()), ("payload", pa.binary())]
)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, which is the cluster's default one if it names none."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``. Repeated rows of the
    page that responds are all responses. Payloads under 100 bytes are always stored whole. Null html is an empty payload; a
    null page_id comes back as null and never is the smallest; rows that share an id but not their html are records of their
    own. Html may be of any length; other columns are ignored; an empty table gives no rows.
    """
    base = qualified(spark, scratch_path(spark, "warc"))
    archives = cut(write_archives(pages, base))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(.*?)>', 1) as bigint)")
    files = archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return read_archives(files, base).select(
        number("id").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
        F.col("uri").alias("url"),
    )
