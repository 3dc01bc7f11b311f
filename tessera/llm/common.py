"""What the corpus operators share: tables, staged results in the shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters that ASCII lower-casing maps.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Arrow batches while a stage runs.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset and all runs in one process, a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = set_before.get() if set_before.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and it outlives executors."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = {k: conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():  # whole texts are long, and a batch is held in memory on both sides
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*dfs: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing will read it again, and lets Spark drop the shuffle files of finished queries.

    Spark drops those when the driver's garbage is collected, which a large heap may put off for long.
    """
    for df in dfs:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    dfs[0].sparkSession._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{top.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))  # the driver serves it to the executors
        _SHIPPED.add(app)


#: Empty what a worker keeps from task to task; see kept().
_KEPT: list = []
#: malloc: larger buffers are mapped one by one, and so go back when freed. Left alone, the bound rises to 32 MB as buffers come and go.
_MMAP_THRESHOLD, _MAPPED = -3, 1 << 18


def kept(cached):
    """Marks a cached function whose results stay in a worker from task to task, until one begins that has no use for them."""
    _KEPT.append(cached.cache_clear)
    return cached


def begin(keep: bool) -> None:
    """What each task does first: unless it keeps them, a worker gives up the caches of earlier tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(_MMAP_THRESHOLD, _MAPPED)
    if not keep:
        for clear in _KEPT:
            clear()


def trimmed(f, keep: bool = False):
    """f for mapInArrow, giving memory back when a task ends: the worker waits beside the executor's other stages."""

    def run(batches):
        begin(keep)
        yield from f(batches)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def map_arrow(df: DataFrame, f, schema: str, keep: bool = False) -> DataFrame:
    """keep: f uses what kept() marks."""
    ship(df.sparkSession)
    return df.mapInArrow(trimmed(f, keep), schema)


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


# --- Arrow and numpy ---------------------------------------------------------------------------


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19, rows: int = 1 << 11):
    """Cuts a batch into runs of ``rows`` rows at most, of about ``most`` bytes of a string column (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(size):
        return
    mark = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        to = min(at + rows, max(at + 1, int(np.searchsorted(mark, mark[at] + most, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and where each row starts (with the end)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
# A second family, unrelated to the first: what must hold for sure needs equal hashes of both.
_BASE2, _CODES2 = 0xBF58476D1CE4E5B9, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))
_UNBASE2 = pow(_BASE2, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """P with P[j] - P[i] = sum of code(data[t]) * base ** t over i <= t < j, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    codes, base = (_CODES2, _BASE2) if second else (_CODES, _BASE)
    np.cumsum(codes[data] * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hash of each span, the same wherever the span stands."""
    return mix((prefix[end] - prefix[start]) * powers(_UNBASE2 if second else _UNBASE, len(prefix))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes other than space and 0x09-0x0D; never across rows), and the first word of each row."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def ngram_counts(data: np.ndarray, row: np.ndarray, rows: int, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams by row (float32, rows x dims); no n-gram crosses from one row to the next.

    ``row`` is the row of each byte, in ascending order.
    """
    out = np.zeros(rows * dims, np.float32)
    for n in sizes:
        m = len(data) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint32)
        for k in range(n):
            key = key * np.uint32(257) + data[k : k + m]
        key = ((key + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (dims.bit_length() - 1))
        at = row[:m] * dims + key
        at = at[row[:m] == row[n - 1 :]]
        out += np.bincount(at, minlength=len(out)).astype(np.float32)
    return out.reshape(rows, dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


#: Identifiers that are broadcast at most; more are joined by a shuffle.
MOST_IDS = 400_000


def text_key(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a struct of the identifier and the text's hash, which tells rows with one identifier apart; and text."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text", *more)


def without(docs: DataFrame, drop: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose (doc_id, text_hash) is in drop; of rows that share one in ``once``, one stays.

    Nulls equal nulls. A short list goes to the documents, so their texts stay in place.
    """

    def listed(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        few = keys.count() <= MOST_IDS
        return rows.join(F.broadcast(keys) if few else keys, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(rows["text"]) == F.col("_hash")), how).select(*docs.columns)

    keys = lambda df, name: stage(df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), name)
    out = listed(keys(drop, "drop"), "left_anti", docs)
    if once is not None and (again := keys(once, "once")).count():
        twice = listed(again, "left_semi", docs).dropDuplicates(["doc_id", "text"])
        out = listed(again, "left_anti", out).unionByName(twice)
    return out
