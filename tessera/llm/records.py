"""Length-delimited binary records of token ids, with a separate offset index.

File format. A record is: length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4), the
payload, masked CRC-32 of the payload (4); numbers are little-endian. A payload is: 1 if the document
has an identifier, else 0 (1 byte), the identifier (8, signed), then its ids, 2 bytes each if the
vocabulary has at most 65,536 entries, else 4. The mask rotates the checksum right by 15 bits and adds
a constant, so that a checksum of data that holds checksums stays sound. The index (``.idx``) has for
each record its offset and its number of ids, 8 bytes each.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, new_path, stage
from .tokens import default_vocabulary, encoded, encoder

#: Fixed value: what the mask adds.
MASK_DELTA = 0xA282EAD8
HEAD, OWNER, OWNER_BYTES = "<QI", "<?q", 9
MANIFEST = "part int, path string, records long, ids long, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(stream, where: str):
    """The payloads of an open stream, one by one; raises where a length or a checksum doesn't hold."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
            raise ValueError(f"{where}: a record's length is damaged")
        n = struct.unpack(HEAD, head)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked(body[:n]) != int.from_bytes(body[n:], "little"):
            raise ValueError(f"{where}: a record is damaged")
        yield body[:n]


def write_records(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes every document's ids in ascending id_col order; returns the manifest (one row for each file, staged).

    Files are ranges of identifiers, so their order is the order of the whole. A task writes under a
    name of its own and moves the file when it is whole; only files of tasks that ended well come into
    the manifest, so lost executors and repeated tasks leave at most unused files. Null text gives the
    end id alone, null identifiers come first, rows with equal identifiers all get a record.
    """
    path = vocabulary or default_vocabulary()

    def write(batches):
        where, root = pafs.FileSystem.from_uri(folder)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        final = f"{root}/part-{part:06d}-{name}"
        width = 2 if encoder(path).size <= 1 << 16 else 4
        at, index, total, out = 0, [], 0, None
        for ids, seqs in encoded(batches, path, end_id, id_col, text_col):
            if out is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(f"{final}.tmp")
            parts = []
            for i, seq in zip(ids.to_pylist(), seqs):
                n = len(seq) // 4
                body = np.frombuffer(seq, "<u4").astype("<u2").tobytes() if width == 2 else seq
                parts.append(frame(struct.pack(OWNER, i is not None, i or 0) + body))
                index.append((at, n))
                at += len(parts[-1])
                total += n
            out.write(b"".join(parts))
        if out is None:
            return
        out.close()
        with where.open_output_stream(f"{final}.idx") as f:
            f.write(np.asarray(index, "<i8").tobytes())
        where.move(f"{final}.tmp", f"{final}.rec")
        row = {"part": [part], "path": [f"{folder}/part-{part:06d}-{name}"], "records": [len(index)], "ids": [total], "width": [width]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first())
    return stage(map_arrow(ordered, write, MANIFEST, keep=True), "manifest")


def read_records(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each record: id_col, start (ids of all records before it), n_tokens, ids_crc32 (of its ids, 4 bytes each).

    A task reads one file. What the driver holds is the list of files (path and counts), which grows
    with their number alone. Lengths, checksums and the index are verified.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for m in sorted(manifest.collect(), key=lambda m: m.part):
        files.append((m.path, base, m.width))
        base += m.ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                where, root = pafs.FileSystem.from_uri(row["path"])
                with where.open_input_stream(f"{root}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                at, start, k, out = 0, row["base"], 0, []
                with where.open_input_stream(f"{root}.rec", buffer_size=1 << 20) as f:
                    for payload in unframe(f, row["path"]):
                        known, owner = struct.unpack_from(OWNER, payload)
                        seq = np.frombuffer(payload, f"<u{row['width']}", offset=OWNER_BYTES)
                        if tuple(index[k]) != (at, len(seq)):
                            raise ValueError(f"{row['path']}: the index is damaged")
                        out.append((owner if known else None, start, len(seq), zlib.crc32(seq.astype("<u4").tobytes())))
                        at, start, k = at + len(payload) + 16, start + len(seq), k + 1
                if k != len(index):
                    raise ValueError(f"{row['path']}: records are missing")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(files, "path string, base long, width int").repartition(len(files))
    return map_arrow(todo, read, schema)


def read_at(path: str, numbers: list[int], width: int = 2) -> list[tuple[int | None, list[int]]]:
    """Records of one file by their numbers, in any order: one seek each, by the index."""
    where, root = pafs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{root}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
    out = []
    with where.open_input_file(f"{root}.rec") as f:
        for k in numbers:
            f.seek(int(index[k, 0]))
            payload = next(unframe(f, path))
            known, owner = struct.unpack_from(OWNER, payload)
            out.append((owner if known else None, np.frombuffer(payload, f"<u{width}", offset=OWNER_BYTES).tolist()))
    return out


def token_records(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """Writes the documents' records to a folder in the shared one and reads them back."""
    folder = new_path(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, end_id=end_id))
