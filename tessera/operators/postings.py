"""An inverted index of chunks, made and kept up at index time (P5, P6, A7, SNK17).

Postings are rows (lexeme, chunk_id, len, positions), written as Parquet by generation and by bucket of the lexeme, in
order of the lexeme. A search reads the buckets of the lexemes it asks for. An update appends a generation: the new
chunks' postings and the list of chunks that went; it counts once its commit, written last, is there.
"""

from __future__ import annotations

import re
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import STOP_WORDS, with_lexemes
from ..functions.text import normalise_separators
from ..sources.io import new_path, ship, stage
from .contain import Grams, clean, gram_index

BUCKETS = 64
#: Chunks whose terms a task holds at a time.
TOGETHER = 256


#: english.TERM, for small letters.
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_STOP = frozenset(STOP_WORDS)
#: Terms whose stems are sent to every task at most; more are joined by a shuffle.
MOST_STEMS = 1_000_000


def spoken(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, len (characters of the chunk), positions (ascending) of the lower-cased terms of each chunk.

    Terms and positions are those of english.positioned(). A chunk is settled where it stands, without a shuffle:
    TOGETHER chunks at a time, each chunk's positions are put under its terms.
    """
    ship(chunks.sparkSession)

    def each(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(start, TOGETHER)
                terms, ids, size, at = [], [], [], []
                for i, (text, n) in enumerate(zip(piece.column("low").to_pylist(), piece.column("len").to_pylist())):
                    found, pos = {}, 0
                    for t in _TERM.findall(text or ""):
                        for part in (t, *t.split("-")) if "-" in t else (t,):
                            if part not in _STOP:
                                found.setdefault(part, []).append(pos)
                            pos += 1
                    terms += found.keys()
                    at += found.values()
                    ids += [i] * len(found)
                    size += [n] * len(found)
                cols = [pa.array(terms, pa.string()), piece.column("chunk_id").take(pa.array(ids, pa.int64())), pa.array(size, pa.int32()), pa.array(at, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "chunk_id", "len", "positions"])

    own = chunks.select("chunk_id", F.length("content").alias("len"), F.lower("content").alias("low"))
    return own.mapInArrow(each, f"term string, chunk_id {dict(chunks.dtypes)['chunk_id']}, len int, positions array<int>")


def postings(chunks: DataFrame) -> DataFrame:
    """lexeme, chunk_id, len, positions: stop words take a position but have no posting; terms of one stem have one each.

    A term is stemmed once, however often it occurs.
    """
    said = stage(spoken(chunks), "spoken")
    # Short rows with much work each: they are dealt to all cores, however few bytes they are.
    terms = stage(said.select("term").distinct().repartition(chunks.sparkSession.sparkContext.defaultParallelism), "terms")
    known = stage(with_lexemes(terms), "stems")
    few = known.limit(MOST_STEMS + 1).count() <= MOST_STEMS
    return said.join(F.broadcast(known) if few else known, "term").select("lexeme", "chunk_id", "len", "positions")


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _generation(path: str, number: int, chunks: DataFrame, gone: DataFrame | None, buckets: int) -> None:
    spark = chunks.sparkSession
    rows = postings(chunks).withColumn("bucket", bucket_of(F.col("lexeme"), buckets))
    # Adaptive execution splits what is large (a frequent lexeme fills its bucket) and joins what is small.
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation={number}")
    if gone is not None:
        gone.select("chunk_id").distinct().write.mode("overwrite").parquet(f"{path}/gone/generation={number}")
    commit = spark.createDataFrame([(number, buckets, gone is not None)], "number int, buckets int, has_gone boolean")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/n={number}")


def commits(spark: SparkSession, path: str) -> list:
    """The commits in order; a handful of rows."""
    return sorted(spark.read.parquet(f"{path}/commits").select("number", "buckets", "has_gone").collect(), key=lambda r: r.number)


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new index of (chunk_id, content) in a folder that has none yet."""
    _generation(path, 0, chunks, None, buckets)


def update_index(chunks: DataFrame, gone: DataFrame, path: str) -> None:
    """The index after chunks were added or replaced, and ``gone`` (chunk_id) were removed. A run that fails midway changes nothing."""
    done = commits(chunks.sparkSession, path)
    replaced = gone.select("chunk_id").unionByName(chunks.select("chunk_id"))
    _generation(path, done[-1].number + 1, chunks, replaced, done[0].buckets)


def read_index(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """The postings that count now. With ``asked`` (lexeme), only the buckets of those lexemes are read (at most as many numbers come to the driver)."""
    done = commits(spark, path)
    buckets = done[0].buckets
    rows = spark.read.option("basePath", f"{path}/postings").parquet(*[f"{path}/postings/generation={c.number}" for c in done])
    if asked is not None:
        rows = rows.where(F.col("bucket").isin(*[r.b for r in asked.select(bucket_of(F.col("lexeme"), buckets).alias("b")).distinct().collect()]))
    went = [f"{path}/gone/generation={c.number}" for c in done if c.has_gone]
    if went:
        # The last generation in which a chunk was replaced or removed; older postings of it don't count.
        last = spark.read.option("basePath", f"{path}/gone").parquet(*went).groupBy("chunk_id").agg(F.max("generation").alias("_last"))
        rows = rows.join(last, "chunk_id", "left").where("_last IS NULL OR generation >= _last")
    return rows.select("lexeme", "chunk_id", "len", "positions")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The same index in one generation, in another folder."""
    buckets = commits(spark, path)[0].buckets
    rows = read_index(spark, path).withColumn("bucket", bucket_of(F.col("lexeme"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "chunk_id").write.partitionBy("bucket").parquet(f"{target}/postings/generation=0")
    spark.createDataFrame([(0, buckets, False)], "number int, buckets int, has_gone boolean").coalesce(1).write.parquet(f"{target}/commits/n=0")


def names(documents: DataFrame) -> DataFrame:
    """document_id, field, text: title and path as they are, and with separators made equal; all in small letters."""
    fields = {"title": F.lower("title"), "path": F.lower("path"), "loose_title": normalise_separators(F.col("title")), "loose_path": normalise_separators(F.col("path"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), clean(v).alias("text")) for k, v in fields.items()])).alias("n")
    return documents.select("document_id", each).select("document_id", "n.field", "n.text").where("text IS NOT NULL")


#: The characters that rare tokens are made of, and what a run must have to hold one (a digit, or a joint between letters).
RUN, RARE_IN = "[a-z0-9._/%,-]+", "[0-9]|[a-z0-9][-_./][a-z0-9]"


def runs(chunks: DataFrame) -> DataFrame:
    """chunk_id, run: the distinct runs of a chunk that can hold a rare token; a rare token in the chunk stands in one of them."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("content"), F.lit(f"({RUN})"), F.lit(1)), lambda r: r.rlike(RARE_IN)))
    return chunks.select("chunk_id", F.explode(found).alias("run"))


class SearchIndex:
    """What searches read: the folder of the postings, names of documents, runs of chunks, and the trigrams of names and runs.

    Each part is written below ``path`` when it is first read, so a search pays for the parts that it reads.
    """

    def __init__(self, chunks: DataFrame, documents: DataFrame, path: str):
        self._chunks, self._documents, self._path = chunks, documents, path

    def _put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{self._path}/{name}")
        return df.sparkSession.read.parquet(f"{self._path}/{name}")

    @cached_property
    def terms(self) -> str:
        write_index(self._chunks, f"{self._path}/terms")
        return f"{self._path}/terms"

    @cached_property
    def names(self) -> DataFrame:
        return self._put(names(self._documents), "names")

    @cached_property
    def runs(self) -> DataFrame:
        return self._put(runs(self._chunks), "runs")

    @cached_property
    def grams(self) -> Grams:
        texts = self.names.select("field", "text").unionByName(self.runs.select(F.lit("run").alias("field"), F.col("run").alias("text")))
        return gram_index(texts, self._put)


def search_index(chunks: DataFrame, documents: DataFrame, path: str | None = None) -> SearchIndex:
    """The index of chunks and documents, written whole below ``path``; without one, part by part to a folder that goes with the session."""
    if path is None:
        return SearchIndex(chunks, documents, new_path(chunks.sparkSession, "index"))
    own = SearchIndex(chunks, documents, path)
    own.terms, own.grams  # noqa: B018
    return own
