"""Sharding along a Hilbert curve through several metadata dimensions (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, utf8

#: Cells of the grid at most: the table of cells is broadcast, so its size has to have a bound.
MOST_CELLS_BITS = 15


def order_keys(df: DataFrame, dims: list[str]) -> list[Column]:
    """For each dimension a number that sorts as the column does; null comes first.

    Strings and binaries give seven bytes after the prefix that all their values share, as the smallest and
    the largest value tell; values that differ only after those sort together. Doubles stay doubles.
    """
    text = [d for d in dims if isinstance(df.schema[d].dataType, (T.StringType, T.BinaryType))]
    shared = {}
    if text:  # two values for each column come to the driver
        raw = lambda d: F.hex(F.col(d).cast("binary"))
        row = df.agg(*[f(raw(d)).alias(f"{i}{n}") for i, d in enumerate(text) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, d in enumerate(text):
            lo, hi = row[f"{i}lo"] or "", row[f"{i}hi"] or ""
            same = next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
            shared[d] = same // 2

    def key(d: str) -> Column:
        kind = df.schema[d].dataType
        if d in shared:
            head = F.substring(F.rpad(F.hex(F.substring(F.col(d).cast("binary"), shared[d] + 1, 7)), 14, "0"), 1, 14)
            return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-(1 << 62)))
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.coalesce(F.col(d).cast("double"), F.lit(float("-inf")))
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.coalesce(F.unix_micros(F.col(d).cast("timestamp")), F.lit(-(1 << 62)))
        return F.coalesce(F.col(d).cast("long"), F.lit(-(1 << 62)))

    return [key(d) for d in dims]


def with_hilbert_index(cells: DataFrame, axes: list[str], bits: int) -> DataFrame:
    """cells with ``curve``: the place on the Hilbert curve of the cell whose coordinates, ``bits`` bits each, are in ``axes``.

    Works on the coordinates as one array: undo the rotations from the highest bit down, Gray-decode,
    then interleave the bits.
    """
    n, high = len(axes), range(bits - 1, 0, -1)
    turns = ", ".join(f"named_struct('q', {1 << k}, 'i', {i})" for k in high for i in range(n))
    masks = ", ".join(str(1 << k) for k in high)
    places = ", ".join(f"named_struct('k', {k}, 'i', {i})" for k in range(bits - 1, -1, -1) for i in range(n))
    cells = cells.withColumn("_x", F.array(*[F.col(a).cast("int") for a in axes]))
    flips = F.lit(0)
    if bits > 1:
        cells = cells.withColumn("_x", F.expr(f"""aggregate(array({turns}), _x, (x, s) -> transform(x, (v, j) -> CASE
            WHEN (x[s.i] & s.q) != 0 THEN IF(j = 0, v ^ (s.q - 1), v)
            WHEN j = 0 OR j = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) ELSE v END))"""))
        flips = F.expr(f"aggregate(array({masks}), 0, (a, q) -> IF((_y[{n - 1}] & q) != 0, a ^ (q - 1), a))")
    cells = cells.withColumn("_y", F.expr("transform(_x, (v, j) -> aggregate(slice(_x, 1, j + 1), 0, (a, b) -> a ^ b))"))
    cells = cells.withColumn("_t", flips)
    curve = F.expr(f"aggregate(array({places}), 0L, (a, s) -> a * 2 + (shiftright(_y[s.i] ^ _t, s.k) & 1))")
    return cells.withColumn("curve", curve).drop("_x", "_y", "_t")


def hilbert_order(df: DataFrame, dims: list[str], ties: list[str], bits: int = 5, bucket: int = 512) -> DataFrame:
    """df with ``curve`` (the cell's position), ``rank`` (gapless from 0 along the curve) and ``total``.

    Every dimension is quantised at its own quantiles into 2 ** bits steps, so steps hold like numbers
    of rows. Where it has fewer different steps (a few languages), these are spread over the whole range:
    else they would only turn the curve's finest bits, and a filter on that dimension would skip nothing. Ranks come without a global sort: rows are counted by cell (a table of 2 ** 15 rows at
    most, whatever the input), cells are summed along the curve, and a cell with more than ``bucket``
    rows is dealt into as many hash buckets as it needs, each ranked by a task of its own.
    """
    if len(dims) * bits > MOST_CELLS_BITS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits give more than 2 ** {MOST_CELLS_BITS} cells")
    steps = 1 << bits
    keys = [f"_k{i}" for i in range(len(dims))]
    axes = [f"_a{i}" for i in range(len(dims))]
    # Written, so that a quantile's lambda compares a column and not the key's whole expression again.
    keyed = stage(df.withColumns(dict(zip(keys, order_keys(df, dims)))), "keys")
    cuts = ", ".join(str(i / steps) for i in range(1, steps))
    # One row of 2 ** bits numbers for each dimension, whatever the input.
    edges = keyed.agg(*[F.expr(f"approx_percentile({k}, array({cuts}), 10000)").alias(k) for k in keys], *[F.max(k).alias(f"{k}m") for k in keys]).first()
    step = {}
    for a, k in zip(axes, keys):
        own = sorted({x for x in edges[k] or [] if x < edges[f"{k}m"]})
        at = F.size(F.filter(F.array(*[F.lit(x) for x in own]), lambda e: e < F.col(k))) if own else F.lit(0)
        step[a] = F.floor(at * steps / (len(own) + 1)).cast("int")
    rows = keyed.withColumns(step).drop(*keys)
    cells = with_hilbert_index(rows.groupBy(*axes).agg(F.count("*").alias("_cell_n")), axes, bits)
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cells = cells.select(
        *axes,
        "curve",
        F.coalesce(F.sum("_cell_n").over(along), F.lit(0)).alias("_cell_at"),
        F.sum("_cell_n").over(whole).alias("total"),
        F.ceil(F.col("_cell_n") / bucket).alias("_buckets"),
    )
    # Written, so that no filter on the curve's place is pushed below the count by cell, to every row.
    cells = stage(cells, "cells")
    # Broadcast: one row for each cell, and there are 2 ** 15 cells at most.
    rows = rows.join(F.broadcast(cells), axes).drop(*axes)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*ties), F.col("_buckets")))
    inside = Window.partitionBy("curve").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("curve", "_b").agg(F.count("*").alias("_n"))
    buckets = buckets.select("curve", "_b", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_bucket_at"))
    own = Window.partitionBy("curve", "_b").orderBy(*ties)
    ranked = rows.join(buckets, ["curve", "_b"]).withColumn(
        "rank", F.col("_cell_at") + F.col("_bucket_at") + F.row_number().over(own) - 1
    )
    return ranked.drop("_b", "_buckets", "_cell_at", "_bucket_at")


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = 16, bits: int = 5) -> DataFrame:
    """df with curve, shard and slot: the curve is cut into ``shards`` runs whose row counts differ by one at most.

    Slots are gapless from 0 in each shard, in curve order; ties in a cell go by a hash bucket and then
    the columns in ``ties``; rows that repeat in all those take their slots in either order, with the same
    result. The steps are approximate quantiles (to a ten-thousandth of the rows; exact below 10,000 values), whose sketches depend on the order in
    which Spark merges them: a rerun of a larger table may cut a step elsewhere. Write the result once (``write_shards``). Nulls in a dimension sort
    before all values. An empty table gives an empty result. Other columns pass through.
    """
    ranked = hilbert_order(df, dims, ties, bits)
    n = F.lit(shards).cast("long")
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(((rank * {shards}) div total) * total + {shards - 1}) div {shards}")
    return ranked.withColumns({"shard": shard.cast("int"), "slot": F.col("rank") - first}).drop("rank", "total")


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """One row for each shard: rows, and the least and greatest value of each dimension (``min_x``, ``max_x``; null if all are) and its ``nulls_x``.

    A filter on any of the dimensions skips the shards whose range it misses.
    """
    each = [x for d in dims for x in (F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}"), F.count_if(F.col(d).isNull()).alias(f"nulls_{d}"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *each)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes a folder for each shard, in files of ``rows_per_file`` neighbours on the curve, sorted by slot: a reader's
    filter on a dimension skips folders' files by their column statistics. A shard's files are written by as many tasks."""
    dealt = sharded.withColumn("_file", F.expr(f"slot div {rows_per_file}")).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    dealt.drop("_file").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents laid along the curve through (source, lang, size); one row for each document.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text has none), text_crc32 (null text as
    empty), law ("rows"), shard, slot, grown_shard (null under this law), curve, source, lang.
    """
    meta = docs.select(
        "doc_id",
        (F.octet_length(utf8(F.col("text"))).cast("long") + 1).alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"),
        "source",
        "lang",
    )
    out = hilbert_shards(meta, ["source", "lang", "size"], ["text_crc32", "doc_id"], shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang",
    )
