"""Exact deduplication as a tree-merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: Rows of a leaf on average at most.
LEAF_ROWS = 5_000_000
KEY = ["_digest", "_bytes", "_check"]


def rounds(leaves: int, fan_in: int) -> list[int]:
    """How far apart partners are in each round of the exchange: 1, fan_in, fan_in ** 2..."""
    return [fan_in**r for r in range(math.ceil(math.log(leaves, fan_in) - 1e-9))] if leaves > 1 else []


def tree_merge(runs: DataFrame, leaves: int, fan_in: int, best) -> DataFrame:
    """Merges the leaves' runs in binomial rounds until one run is left.

    A run has one row for each digest: the best identifier and the number of rows so far. It is cut into
    slices by the digest's first bits, and each slice is kept sorted by digest. In a round of distance d, nodes
    d apart are partners: the first of ``fan_in`` partners takes the others' runs, merges all of them in the order of
    their digests and keeps the best of each. A slice of a node is merged by one task, whatever the node, so a
    digest that a third of all rows share has at most ``fan_in`` rows there.
    """
    for apart in rounds(leaves, fan_in):
        taker = runs.withColumn("_node", F.expr(f"_node - _node % {apart * fan_in}"))
        # Dealt by slice and sorted once: the aggregate below works along this order, without another exchange or sort.
        order = taker.repartition("_node", "_slice").sortWithinPartitions("_node", "_slice", *KEY)
        runs = order.groupBy("_node", "_slice", *KEY).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
    return runs.drop("_node")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=ascii_lower,
    keep: str = "min",
    leaves: int | None = None,
    fan_in: int = 8,
) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are. Of each group the row with the smallest (or
    largest, keep="max") identifier stays. Identifiers are verified at every level: runs are merged
    on SHA-256, byte length and a second, unrelated hash together, so rows meet only if all agree.

    The rows' digests are dealt to ``leaves`` (64, or more where a leaf would have over LEAF_ROWS rows) by a hash of the identifier. Each leaf makes its run
    (one row for each digest it has), the runs are merged in a tree, and the verdict goes back along
    (leaf, digest): a hot digest is spread over all leaves on the way up and on the way down.

    Null text counts as empty; empty texts are a group like any other. Null identifiers sort before
    all others. Of repeated rows with the same identifier and text exactly one is kept. An empty
    table gives an empty result. Other columns are neither read nor returned.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text: Column = normalise(F.col(text_col)).cast("binary")
    rows = stage(
        df.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
            "_id",
            F.unhex(F.sha2("_t", 256)).alias("_digest"),
            F.octet_length("_t").alias("_bytes"),
            F.xxhash64("_t").alias("_check"),
            F.expr("monotonically_increasing_id()").alias("_row"),
        ),
        "digests",
    )
    leaves = leaves or max(64, fan_in ** math.ceil(math.log(max(rows.count() / LEAF_ROWS, 1), fan_in)))
    rows = rows.withColumn("_slice", F.conv(F.substring(F.hex("_digest"), 1, 3), 16, 10).cast("int"))
    rows = rows.withColumn("_node", F.pmod(F.xxhash64("_id", "_row"), F.lit(leaves)))
    runs = stage(
        rows.groupBy("_node", "_slice", *KEY).agg(best(F.struct("_id", "_row")).alias("_best"), F.count("*").alias("_n")), "runs"
    )
    verdict = tree_merge(runs, leaves, fan_in, best)
    back = stage(
        runs.select("_node", *KEY).join(verdict.where("_n > 1").drop("_slice"), KEY).select("_node", *KEY, "_best", "_n"), "verdicts"
    )
    hit = rows.join(back, ["_node", *KEY], "left")
    return hit.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | (F.col("_best._row") == F.col("_row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
