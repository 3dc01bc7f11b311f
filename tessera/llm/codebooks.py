"""Vector codes: parts of integer vectors by the nearest entry of small codebooks, learned in rounds over all rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, map_arrow, stage


def limit_of(width: int) -> int:
    """Greatest size of a component: squared distances of parts of this width stay below 2 ** 62."""
    return int((2**62 / max(width, 1)) ** 0.5) // 2


def bounds(dims: int, parts: int) -> list[int]:
    """Where the parts begin (with the end): equal if dims is a multiple of parts, else their widths differ by one at most."""
    return [p * dims // parts for p in range(parts + 1)]


def finite(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have ``dims`` components, all of them finite, and these."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(size == dims)
    flat = column.take(pa.array(right)).flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(right), dims)  # nulls become NaN
    fine = np.isfinite(x).all(1) if dims else np.ones(len(right), bool)
    return right[fine], x[fine]


def quantised(x: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x); beyond limit_of() the widest part, that limit."""
    most = limit_of(-(-x.shape[1] // parts))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the first of several) and its squared distance, by |x|^2 - 2 x.c + |c|^2 in int64."""
    far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def usable(column: str) -> F.Column:
    """The vector isn't null and all of its components are finite."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & ~bad


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the usable vectors with the smallest (vec_id, vector), nulls last: ``entries`` rows come to the driver."""
    own = vectors.where(usable("embedding")).orderBy(F.asc_nulls_last("vec_id"), "embedding")
    first = [r.embedding for r in own.limit(entries).select("embedding").collect()]
    dims = len(first[0]) if first else 0
    if any(len(v) != dims for v in first):
        first = [r.embedding for r in own.where(F.size("embedding") == dims).limit(entries).select("embedding").collect()]
    rows = np.array(first, np.float64).reshape(len(first), dims)
    cut = bounds(dims, parts)
    whole = quantised(rows, scale, parts)
    return [whole[:, a:b].copy() for a, b in zip(cut[:-1], cut[1:])]


def refined(vectors: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, every entry becomes the floored mean of its parts.

    Tasks add up their rows, one row for each entry in use; these meet by (part, entry) in a shuffle. What
    comes to the driver is of the codebooks' size. An entry without parts stays.
    """
    parts, dims = len(books), sum(b.shape[1] for b in books)
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # parts x entries x width integers

    def sums(batches):
        books = sent.value
        cut = bounds(dims, parts)
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, x = finite(batch.column("embedding"), dims)
            x = quantised(x, scale, parts)
            for p, book in enumerate(books):
                own = x[:, cut[p] : cut[p + 1]]
                best, _ = nearest(own, book)
                np.add.at(total[p], best, own)
                count[p] += np.bincount(best, minlength=len(book))
        rows = [(p, e, int(count[p][e]), total[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(count[p]).tolist()]
        kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)

    width = max(b.shape[1] for b in books)
    each = map_arrow(vectors.select("embedding"), sums, "part int, entry int, n long, total array<long>")
    merged = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in merged.collect():
        out[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(out[r.part].shape[1])]
    sent.unpersist()
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def learn(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over all rows; every round reads the vectors again, none is kept."""
    books = first_books(vectors, parts, entries, scale)
    if len(books[0]):
        for _ in range(rounds):
            books = refined(vectors, books, scale)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances of all parts together)."""
    parts, dims = len(books), sum(b.shape[1] for b in books)
    if any(len(b) > 256 for b in books):
        raise ValueError("two hex digits hold 256 entries")
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    names = ["vec_id", "label", "code", "error"]

    def codes(batches):
        books = sent.value
        cut = bounds(dims, parts)
        for batch in batches:
            rows, x = finite(batch.column("embedding"), dims)
            x = quantised(x, scale, parts)
            code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            if len(books[0]):
                for p, book in enumerate(books):
                    code[:, p], far = nearest(x[:, cut[p] : cut[p + 1]], book)
                    error += far
            at = pa.array(rows)
            text = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), text, pa.array(error)], names=names)

    kinds = dict(vectors.dtypes)
    return map_arrow(vectors.select("vec_id", "label", "embedding"), codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = 4096) -> DataFrame:
    """codes and ``approx``, the vector that the code stands for: the entries' components / scale."""
    lists = [F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in b.tolist()]) for b in books]
    own = [F.get(table, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p, table in enumerate(lists)]
    return codes.withColumn("approx", F.concat(*own))


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for all usable rows of (vec_id, embedding, label).

    Left out are rows whose vector is null, holds a null or a number that isn't finite, or has another length
    than the usable vector with the smallest vec_id (no distance is defined for it). Rows with one vec_id are
    rows of their own; a null vec_id comes after all others; equal labels, nulls together, share label_error. An empty
    table gives an empty one. Fewer rows than entries give fewer entries. Components are exact up to 92,681 in size
    with parts of 8 (limit_of), larger ones count as that. Other columns are ignored.
    """
    own = vectors.select("vec_id", "embedding", "label")
    books = learn(own, parts, entries, rounds, scale)
    coded = stage(encode(own, books, scale), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    # Sent to all tasks up to MOST_IDS labels; beyond that both sides of the join are shuffled.
    few = by_label.limit(MOST_IDS + 1).count() <= MOST_IDS
    joined = coded.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
