"""Vector expressions, blocked kernels and the embedder plug-in."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import ship
from .cells import similar_pairs as similar_pairs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """V6; null where a norm is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalise(v: Column) -> Column:
    """V2: to unit length; the zero vector stays."""
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / n)


def truncate(v: Column, dim: int) -> Column:
    """V3: the first ``dim`` coordinates, to unit length again."""
    return normalise(F.slice(v, 1, dim))


def centroids(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """V7, A5: mean vector by key: one pass, with partial sums before the shuffle."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims)]
    return df.where(F.col(vector).isNotNull()).groupBy(key).agg(F.array(*means).alias("centroid"))


def top_similar(base: DataFrame, queries: list[tuple], k: int, id_col: str = "id", vector: str = "vec") -> DataFrame:
    """The k nearest of base for each query: query_id, id, sim (6 places), rank from 1; ties go by id.

    ``queries`` are (query_id, vector) on the driver, a batch of bounded size. Each task multiplies its
    vectors with all queries and passes on k rows for each query at most, so the shuffle doesn't grow
    with base's rows but with its partitions. Null and zero vectors aren't ranked.
    """
    from pyspark.sql import Window

    spark = base.sparkSession
    if not queries:
        return spark.createDataFrame([], "query_id long, id long, sim double, rank int")
    names = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1, norms)[:, None]

    def part(batches):
        best: dict = {}
        for batch in batches:
            vec = batch.column("vec")
            keep = np.array([v is not None for v in vec.to_pylist()]) if vec.null_count else np.ones(len(vec), bool)
            if not keep.any():
                continue
            rows = np.array([x for x, ok in zip(vec.to_pylist(), keep) if ok], np.float64)
            ids = batch.column("id").to_numpy()[keep]
            size = np.linalg.norm(rows, axis=1)
            rows, ids = rows[size > 0] / size[size > 0][:, None], ids[size > 0]
            sims = np.round(unit @ rows.T, 6)
            for i in np.flatnonzero(norms > 0):
                order = np.lexsort((ids, -sims[i]))[:k]
                best[i] = sorted([*best.get(i, []), *zip(-sims[i][order], ids[order])])[:k]
        rows = [(names[i], int(j), -float(s)) for i, found in best.items() for s, j in found]
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "sim"])

    found = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec")).mapInArrow(part, "query_id long, id long, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(base: DataFrame, queries: list[tuple], above: float, k: int) -> DataFrame:
    """query_id, document_id, sim (6 places): from each task the k documents whose best vector is nearest, of those above ``above``.

    base has document_id and vec. The document with the query's own id is left out. The k nearest of all are
    among these: what keeps a document out of a task's k keeps it out of the k of all. Ties go by document_id.
    """
    spark = base.sparkSession
    if not queries:
        return spark.createDataFrame([], "query_id long, document_id long, sim double")
    names = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1, norms)[:, None]

    def part(batches):
        best: list[dict] = [{} for _ in names]
        for batch in batches:
            rows = np.array(batch.column("vec").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            size = np.linalg.norm(rows, axis=1)
            docs = batch.column("document_id").to_numpy()[size > 0]
            if not len(docs):
                continue
            sims = np.round(unit @ (rows[size > 0] / size[size > 0][:, None]).T, 6)
            for i in np.flatnonzero(norms > 0):
                at = np.flatnonzero((sims[i] > above) & (docs != names[i]))
                at = at[np.lexsort((docs[at], -sims[i][at]))]
                first = np.sort(np.unique(docs[at], return_index=True)[1])[:k]
                for d, x in zip(docs[at[first]].tolist(), sims[i][at[first]].tolist()):
                    best[i][d] = max(x, best[i].get(d, x))
                best[i] = dict(sorted(best[i].items(), key=lambda e: (-e[1], e[0]))[:k])
        out = [(q, d, x) for q, found in zip(names, best) for d, x in found.items()]
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "document_id", "sim"])

    own = base.where("vec IS NOT NULL AND document_id IS NOT NULL").select(F.col("document_id").cast("long").alias("document_id"), "vec")
    return own.mapInArrow(part, "query_id long, document_id long, sim double")


class Embedder(Protocol):
    """V1: texts to vectors. A model is loaded once in each worker by whoever implements this."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic stand-in without a model: signed hashes of words, to unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)


def embed(df: DataFrame, text: str, embedder: Embedder, into: str = "embedding", batch: int = 16) -> DataFrame:
    """V1, SRC6: df with a vector column, texts sent to the embedder ``batch`` at a time."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(into, ArrayType(FloatType()))])

    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            vecs = [v for i in range(0, len(texts), batch) for v in np.asarray(embedder(texts[i : i + batch]), np.float32).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vecs, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)
