"""WARC archives: a writer with revisit records, and a reader that splits archives by byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, new_path, stage, utf8

#: The start of a gzip member, and of a record.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARCHIVES = "path string, bytes long, records long"
RECORDS = "path string, at long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def member(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member of its own."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(VERSION + lines + b"\r\n" + block + b"\r\n\r\n") + coder.flush()


def write_archives(pages: DataFrame, folder: str, least: int = 100, id_col: str = "page_id") -> DataFrame:
    """Writes a record for each page; returns the list of archives (staged): path, bytes, records.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest identifier is a
    response and the others revisit it (pages that repeat that identifier are responses too). Null
    html is an empty payload. First runs of digests say which payloads repeat; that table is written
    to the shared folder, so that the join with the pages can split a digest that many pages have.
    A task writes under a name of its own and moves the whole archive.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stage(groups.where("n > 1").select("digest", "first"), "firsts")
    marked = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def write(batches):
        where, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, size, n = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(f"{root}/{name}.tmp")
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                data = member(*row)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is None:
            return
        out.close()
        where.move(f"{root}/{name}.tmp", f"{root}/{name}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return stage(map_arrow(marked, write, ARCHIVES), "archives")


class Window:
    """Bytes of an open file from ``at`` on, read as they are asked for."""

    def __init__(self, stream, at: int, step: int = 1 << 20):
        self.stream, self.base, self.step, self.data, self.ended = stream, at, step, b"", False
        stream.seek(at)

    def grow(self) -> bool:
        more = b"" if self.ended else self.stream.read(self.step)
        self.ended = self.ended or not more
        self.data += more
        return bool(more)

    def drop(self, to: int) -> None:
        self.data, self.base = self.data[to - self.base :], to

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The member at ``at`` and where it ends; None if no sound record starts there."""
        coder, out, k = zlib.decompressobj(31), [], at - self.base
        seen = 0
        while not coder.eof:
            if k >= len(self.data) and not self.grow():
                return None
            try:
                out.append(coder.decompress(self.data[k : k + (1 << 16)]))
            except zlib.error:
                return None
            k = min(k + (1 << 16), len(self.data))
            if seen is not None and (seen := seen + len(out[-1])) >= len(VERSION):
                if not b"".join(out).startswith(VERSION):
                    return None
                seen = None
        text = b"".join(out)
        return (text, self.base + k - len(coder.unused_data)) if text.startswith(VERSION) else None


def members(stream, start: int, end: int):
    """Offset and bytes of each record that starts in [start, end).

    Scans for the magic number; a candidate counts if it inflates whole (checksum included) to
    something that starts as a record does. After a sound member the next starts where it ends, so only
    the first of a range is searched for.
    """
    window, at, sure = Window(stream, start), start, False
    while at < end:
        if not sure:
            k = window.data.find(MAGIC, at - window.base)
            while k < 0:
                before = len(window.data)
                if window.base + before >= end + len(MAGIC) or not window.grow():
                    return
                k = window.data.find(MAGIC, max(0, before - len(MAGIC) + 1))
            at = window.base + k
            if at >= end:
                return
        got = window.inflate(at)
        if got is None:
            if sure and at - window.base >= len(window.data):
                return
            at, sure = at + 1, False
            continue
        yield at, got[0]
        at, sure = got[1], True
        window.drop(at)


def parse(text: bytes) -> dict:
    """Fields of a record; the payload's digest and length are verified where the payload is there."""
    head, _, rest = text.partition(b"\r\n\r\n")
    field = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode().partition(": ")
        field[k.lower()] = v
    block = rest[: int(field["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: None if x in (None, "<urn:page:none>") else int(x[len("<urn:page:") : -1])
    kind, digest, length = field["warc-type"], field["warc-payload-digest"].removeprefix("sha256:"), int(field["x-payload-length"])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{field['warc-record-id']}: the payload is damaged")
    return {
        "page_id": number(field["warc-record-id"]), "url": field["warc-target-uri"], "record_type": kind, "refers_to": number(field.get("warc-refers-to")),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def read_archives(archives: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """One row for each record of the archives (path, bytes): its place, fields and payload (null for revisits).

    Each task reads a range of bytes of an archive and the rest of the last record that starts there,
    so an archive of any size is read by many tasks. A task holds one record and about a megabyte.
    """

    def read(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                where, root = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_file(root) as stream:
                    for at, text in members(stream, start, end):
                        rows.append({"path": path, "at": at} | parse(text))
                        size += len(text)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    shape = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORDS.split(", "))])
    ranges = archives.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"), "bytes"
    ).select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    n = archives.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / range_bytes))).first()[0] or 1
    return map_arrow(ranges.repartition(int(n)), read, RECORDS)  # a task for each range


def pages_by_archive(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back; one row for each page, without the payload."""
    archives = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
