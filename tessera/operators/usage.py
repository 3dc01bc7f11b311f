"""Usage and change analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stage
from .spread import before_ranges, in_ranges


def since(ts: Column, as_of: str, days: int) -> Column:
    """P10: after as_of minus days (strictly)."""
    return ts > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def by_endpoint(events: DataFrame) -> DataFrame:
    """A1: calls, mean duration (rounded) and errors (status of 400 or more) of each endpoint."""
    return events.groupBy("endpoint").agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms")).alias("avg_ms"), F.count_if(F.coalesce(F.col("status") >= 400, F.lit(False))).alias("errors"))


def by_day(events: DataFrame) -> DataFrame:
    """A2: calls of each UTC day."""
    return events.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"))


def by_agent(events: DataFrame) -> DataFrame:
    """A3: calls of each named agent."""
    return events.where("agent IS NOT NULL").groupBy("agent").agg(F.count("*").alias("calls"))


def totals(events: DataFrame) -> DataFrame:
    """A4: all calls, reads (GET), writes, and the first."""
    return events.agg(F.count("*").alias("calls"), F.count_if(F.col("method") == "GET").alias("reads"), F.count_if(F.col("method") != "GET").alias("writes"), F.min("ts").alias("first_ts"))


def changes(rows: DataFrame, as_of: str, days: int = 7, limit: int = 30, created="created_at", updated="updated_at", tie="id") -> DataFrame:
    """What changed in the last days, newest first, with is_new."""
    days, limit = min(max(int(days), 1), 90), min(max(int(limit), 1), 200)
    return rows.where(since(F.col(updated), as_of, days)).withColumn("is_new", F.col(created) == F.col(updated)).orderBy(F.desc(updated), tie).limit(limit)


def proposals(docs: DataFrame, include_all: bool = False, limit: int = 30) -> DataFrame:
    """agents' notes that wait for review: proposed first, newest first."""
    own = docs.where(F.col("path").startswith("agents/"))
    if not include_all:
        own = own.where("status = 'proposed'")
    return own.orderBy(F.desc(F.coalesce(F.col("status") == "proposed", F.lit(False))), F.desc("updated_at"), "path").limit(min(max(limit, 1), 200))


def latest_edits(edits: DataFrame, key="path", ts="created_at", tie="edit_id") -> DataFrame:
    """The newest edit of each path that isn't reverted."""
    newest = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return edits.where("reverted_at IS NULL").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def floor_percentile(values: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """The value at index min(n - 1, floor(p / 100 * n)) of the sorted values, for each p.

    Counts of each distinct value are summed along the order in ranges split at quantiles, so no task sorts all rows.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    placed = stage(in_ranges(counts, "v"), "placed")
    # One row for each of at most 256 ranges.
    ranges = before_ranges(placed.groupBy("_range").agg(F.sum("c").alias("sc")), "sc").withColumn("n", F.sum("sc").over(Window.partitionBy()))
    inside = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    reach = placed.join(F.broadcast(ranges.select("_range", "n", F.coalesce("_before", F.lit(0)).alias("at"))), "_range").withColumn("to", F.col("at") + F.sum("c").over(inside))
    wanted = F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("p")
    asked = reach.select("v", "c", "to", "n", wanted).withColumn("k", F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n") / 100)))
    return asked.where("k < to AND k >= to - c").select("p", F.col("v").alias("value"))


def mean_latency(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Calls and mean duration (rounded to 0.1 ms) over the events that have a duration, of all or by the columns given."""
    own = events.where("duration_ms IS NOT NULL")
    return own.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 1).alias("mean_ms"))


def coverage(indexed: DataFrame, total: DataFrame) -> DataFrame:
    """Indexed, total and what is left (never negative)."""
    a, b = indexed.agg(F.count("*").alias("indexed")), total.agg(F.count("*").alias("total"))
    return a.join(b, how="cross").withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("indexed")))
