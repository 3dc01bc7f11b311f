"""Change streams: debounce, retry, quiet periods, once-per-key (ST1-ST6, SRC10)."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import pull_request_repo
from ..functions.vocab import TUNING
from ..operators.spread import before_ranges, in_ranges
from ..sources.io import ship, stage


def debounced(events: DataFrame, watermark: str = "1 minute", gap_ms: int = TUNING.debounce_ms) -> DataFrame:
    """ST1: path, first, last and the last action of each burst of events (path, action, ts) with no gap of gap_ms. Batch and stream alike."""
    own = events.withWatermark("ts", watermark) if events.isStreaming else events
    burst = own.groupBy("path", F.session_window("ts", f"{gap_ms} milliseconds").alias("w")).agg(F.max_by("action", "ts").alias("action"), F.count("*").alias("events"))
    return burst.select("path", F.col("w.start").alias("first_ts"), F.col("w.end").alias("quiet_ts"), "action", "events")


def quiet_periods(events: DataFrame, watermark: str = "5 minutes", gap_s: int = TUNING.quiet_s) -> DataFrame:
    """ST3: a row for each time that nothing happened for gap_s seconds: since when, until when, and how many events before.

    A batch is cut into time ranges at the quantiles of its times. Each range finds where its sessions begin; the last
    time before a range, and the number of beginnings before it, come from one row for each range. So sessions that
    cross borders are whole, and no task sees all events. A stream has one key, so one task of it keeps the session.
    """
    if events.isStreaming:
        w = F.session_window("ts", f"{gap_s} seconds")
        return events.withWatermark("ts", watermark).groupBy(w.alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("first_ts"), F.col("w.end").alias("quiet_ts"), "events")
    times = events.where("ts IS NOT NULL").groupBy("ts").agg(F.count("*").alias("n"))
    placed = stage(in_ranges(times, "ts"), "times")
    ends = before_ranges(placed.groupBy("_range").agg(F.max("ts").alias("last")), "last", F.max).select("_range", F.col("_before").alias("prior"))
    own = Window.partitionBy("_range").orderBy("ts")
    previous = F.coalesce(F.lag("ts").over(own), F.col("prior"))
    gap = F.expr(f"INTERVAL {int(gap_s)} SECONDS")
    begun = placed.join(F.broadcast(ends), "_range").withColumn("begins", (previous.isNull() | (F.col("ts") - previous >= gap)).cast("long"))
    begun = stage(begun.withColumn("own", F.sum("begins").over(own)).select("_range", "ts", "n", "begins", "own"), "begun")
    offset = before_ranges(begun.groupBy("_range").agg(F.sum("begins").alias("b")), "b").select("_range", F.coalesce("_before", F.lit(0)).alias("at"))
    numbered = begun.join(F.broadcast(offset), "_range").withColumn("session", F.col("at") + F.col("own"))
    return numbered.groupBy("session").agg(F.min("ts").alias("first_ts"), (F.max("ts") + gap).alias("quiet_ts"), F.sum("n").alias("events")).drop("session")


def announce(issues: DataFrame, comments: DataFrame, watermark: str = "1 hour", keep_days: int | None = None) -> DataFrame:
    """ST6: what becomes of each issue (issue_id, body, ts), once: status (posted, skipped, empty), repo, comment, ts.

    The first event of an issue that names a pull request decides; events before it leave no state, those after it
    change nothing. ``comments`` (repo, comment): a repo that isn't there is skipped, one with nothing to say is empty.
    The state of an issue stays for ``keep_days`` after its last event (None: for ever). Batch and stream alike; the
    comments of a stream are read anew in each batch.
    """
    ship(issues.sparkSession)
    known = comments.select("repo", F.struct(F.lit(True).alias("here"), "comment").alias("_c"))
    named = issues.where("issue_id IS NOT NULL AND ts IS NOT NULL").select("issue_id", "ts", pull_request_repo(F.col("body")).alias("repo")).where("repo IS NOT NULL")
    own = named.withWatermark("ts", watermark) if named.isStreaming else named
    status = F.when(F.col("_c").isNull(), "skipped").when(F.coalesce(F.col("_c.comment"), F.lit("")) == "", "empty").otherwise("posted")
    judged = own.join(known, "repo", "left").select("issue_id", "ts", "repo", status.alias("status"), F.when(status == "posted", F.col("_c.comment")).alias("comment"))
    if not issues.isStreaming:
        first = Window.partitionBy("issue_id").orderBy("ts", "repo")
        return judged.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("issue_id", "status", "repo", "comment", "ts")
    return judged.groupBy("issue_id").applyInPandasWithState(
        functools.partial(first_of_key, keep_ms=keep_days and keep_days * 86_400_000), "issue_id long, status string, repo string, comment string, ts timestamp", "status string", "append",
        GroupStateTimeout.EventTimeTimeout if keep_days else GroupStateTimeout.NoTimeout,
    )


def first_of_key(key, parts, state, keep_ms=None):
    """The first row of a key without state is kept; the state is its status."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(parts))
    done = state.exists
    first = rows.sort_values(["ts", "repo"], kind="stable").head(1)
    if not done:
        state.update((first["status"].iloc[0],))
    if keep_ms:
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + keep_ms, state.getCurrentWatermarkMs() + 1))
    if not done:
        yield first[["issue_id", "status", "repo", "comment", "ts"]]


def advance(state: dict, upto: float, gap: float) -> list[tuple]:
    """What a debounced trigger does by the time ``upto``: the run that its timer starts, or the one rerun that it queues.

    state: due (when the timer ends, None without one), pending (triggers since), running, queued (triggers for the rerun).
    """
    runs = []
    if state["due"] is not None and state["due"] <= upto:
        if state["running"]:
            state["queued"] += state["pending"]
        else:
            runs.append((state["due"], state["pending"]))
            state["running"] = True
        state["due"], state["pending"] = None, 0
    return runs


def step(state: dict, at: float, kind: str, gap: float) -> list[tuple]:
    """The next event at a time: a trigger puts the timer off, ``done`` ends the run and starts a queued one. Gives runs (start, triggers)."""
    runs = advance(state, at, gap)
    if kind == "done":
        if state["running"] and state["queued"]:
            runs.append((at, state["queued"]))
            state["queued"] = 0
        else:
            state["running"] = False
    else:
        state["due"], state["pending"] = at + gap, state["pending"] + 1
    return runs


_FIELDS = ("due", "pending", "running", "queued")


def _single_flight(key, parts, state, gap):
    now = dict(zip(_FIELDS, state.get)) if state.exists else {"due": None, "pending": 0, "running": False, "queued": 0}
    runs = []
    if state.hasTimedOut:
        runs += advance(now, state.getCurrentWatermarkMs() / 1000, gap)
    else:
        rows = pd.concat(list(parts)).sort_values(["at", "kind"], kind="stable")
        for at, kind in zip(rows["at"], rows["kind"]):
            runs += step(now, at, kind, gap)
        runs += advance(now, state.getCurrentWatermarkMs() / 1000, gap)
    if now["due"] is None and not now["running"]:
        state.remove()
    else:
        state.update(tuple(now[f] for f in _FIELDS))
        if now["due"] is not None:
            state.setTimeoutTimestamp(max(int(now["due"] * 1000), state.getCurrentWatermarkMs() + 1))
    if runs:
        yield pd.DataFrame({"key": key[0], "started": [r[0] for r in runs], "triggers": [r[1] for r in runs]})


def single_flight(events: DataFrame, watermark: str = "10 seconds", gap_s: float = 3.0) -> DataFrame:
    """ST4: (key, started, triggers) of a stream of events (key, ts, kind: trigger or done): when runs start, and for how many triggers.

    A run starts gap_s after the last trigger of a burst, never while another of its key runs: what comes meanwhile
    makes one rerun, at the end of the run. Timers are kept in the state and end with the watermark; times are seconds.
    Events of one time count triggers last. Rows without key or time are left out.
    """
    ship(events.sparkSession)
    own = events.where("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark).select("key", "ts", F.expr("unix_micros(ts) / 1e6D").alias("at"), "kind")
    return own.groupBy("key").applyInPandasWithState(functools.partial(_single_flight, gap=gap_s), "key long, started double, triggers long", "due double, pending long, running boolean, queued long", "append", GroupStateTimeout.EventTimeTimeout)


def run_through(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream has now, run to its end into a folder (out, checkpoint), and read back."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def unlinked(seen: DataFrame, listing: DataFrame) -> DataFrame:
    """SRC10: listing differences as events: (path, action): add, change or unlink, from (path, hash) seen before and (path, hash) now."""
    both = seen.select("path", F.col("hash").alias("was")).join(listing.select("path", F.col("hash").alias("now")), "path", "full")
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "unlink").when(F.col("was") != F.col("now"), "change")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def once_per_key(events: DataFrame, key: str, watermark: str = "7 days") -> DataFrame:
    """ST6: the first event of each key; state goes after the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def note_stream(spark: SparkSession, folder: str, schema: str = "path string, action string, ts timestamp") -> DataFrame:
    """SRC10, SRC11: changes as JSON lines in files that writers move into the folder whole (ST7)."""
    return spark.readStream.schema(schema).json(folder)


def run_batches(changes: DataFrame, handle, retries: str, checkpoint: str, once: bool = False):
    """ST2, ST4, ST5: calls handle(batch) with each micro-batch and what failed before; one query for a checkpoint is the lock.

    ``handle`` returns the rows that failed; they are kept below ``retries`` by batch and come again with
    the next, unless a newer event of the same path replaces them.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        todo = batch
        if number > 0:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{retries}/{number - 1}")
            if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
                before = spark.read.schema(batch.schema).parquet(f"{retries}/{number - 1}")
                todo = batch.unionByName(before.join(batch.select("path").distinct(), "path", "left_anti").select(*batch.columns))
        handle(todo).write.mode("overwrite").parquet(f"{retries}/{number}")

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{TUNING.retry_s} seconds")).start()
