"""Streams run to their end, started again from their checkpoints, against plain simulations; orders over whole tables."""

import heapq
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import usage
from tessera.operators.spread import in_ranges
from tessera.streaming import freshness

T = datetime(2024, 1, 1)


def put(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r, default=str) for r in rows))


def test_announce_once_across_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    url = lambda repo: f"see https://github.com/acme/{repo}/pull/3"
    comments = spark.createDataFrame([("known", "impact"), ("quiet", None), ("blank", "")], "repo string, comment string")
    batches = [
        [(1, "no link", 0), (2, url("known"), 1), (2, url("other"), 2), (3, url("quiet"), 3), (None, url("known"), 3)],
        [(1, url("other"), 10), (1, url("known"), 11), (2, url("known"), 12), (3, url("known"), 13), (4, url("blank"), 14), (5, None, 15)],
    ]
    every = []
    for n, rows in enumerate(batches):
        put(folder, n, [{"issue_id": i, "body": b, "ts": T + timedelta(seconds=s)} for i, b, s in rows])
        live = freshness.note_stream(spark, str(folder), "issue_id long, body string, ts timestamp")
        done = freshness.run_through(freshness.announce(live, comments), f"file://{tmp_path}/run")
        every.append({(r.issue_id, r.status, r.repo, r.comment) for r in done.collect()})
    first = {(2, "posted", "known", "impact"), (3, "empty", "quiet", None)}
    assert every == [first, first | {(1, "skipped", "other", None), (4, "empty", "blank", None)}]
    whole = spark.createDataFrame([(i, b, T + timedelta(seconds=s)) for rows in batches for i, b, s in rows], "issue_id long, body string, ts timestamp")
    assert {(r.issue_id, r.status, r.repo, r.comment) for r in freshness.announce(whole, comments).collect()} == every[-1]


def test_announce_state_ends(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    comments = spark.createDataFrame([("r", "c")], "repo string, comment string")
    got = []
    for n, day in enumerate([0, 1, 30, 31]):
        put(folder, n, [{"issue_id": i, "body": "https://github.com/a/r/pull/1", "ts": T + timedelta(days=day)} for i in ((1,) if n != 2 else (2,))])
        live = freshness.note_stream(spark, str(folder), "issue_id long, body string, ts timestamp")
        done = freshness.run_through(freshness.announce(live, comments, keep_days=7), f"file://{tmp_path}/run")
        got.append(sorted((r.issue_id, (r.ts - T).days) for r in done.collect()))
    assert got == [[(1, 0)], [(1, 0)], [(1, 0), (2, 30)], [(1, 0), (1, 31), (2, 30)]]


def simulated(events, gap, until):
    """Runs (key, started, triggers) by an event queue, for timers up to ``until``."""
    out = []
    for key in {k for k, _, _ in events}:
        queue = [(at, kind == "trigger", kind, 0) for k, at, kind in events if k == key]
        heapq.heapify(queue)
        version, waiting, running, rerun = 0, 0, False, 0
        while queue:
            at, _, kind, number = heapq.heappop(queue)
            if kind == "trigger":
                version, waiting = version + 1, waiting + 1
                heapq.heappush(queue, (at + gap, False, "a timer", version))
            elif kind == "done":
                if running and rerun:
                    out.append((key, at, rerun))
                    rerun = 0
                else:
                    running = False
            elif number == version and at <= until:  # an older timer was put off
                if running:
                    rerun += waiting
                else:
                    out.append((key, at, waiting))
                    running = True
                waiting = 0
    return sorted(out)


def test_single_flight_against_a_simulation(spark, tmp_path):
    rng = random.Random(4)
    folder = tmp_path / "in"
    folder.mkdir()
    times = sorted(rng.sample(range(4000), 600))
    events = [(rng.randrange(6), t / 4, rng.choice(["trigger", "trigger", "done"])) for t in times]
    for n, rows in enumerate((events[:350], events[350:])):
        put(folder, n, [{"key": k, "ts": T + timedelta(seconds=at), "kind": kind} for k, at, kind in rows])
        live = freshness.note_stream(spark, str(folder), "key long, ts timestamp, kind string")
        done = freshness.run_through(freshness.single_flight(live), f"file://{tmp_path}/run")
        got = sorted((r.key, r.started - T.timestamp(), r.triggers) for r in done.collect())
        seen = (events[:350], events)[n]
        until = seen[-1][1] - 10
        want = [w for w in simulated(seen, 3.0, until)]
        assert [(k, round(s, 3), n) for k, s, n in got if s <= until] == [(k, round(s, 3), n) for k, s, n in want if s <= until]
    assert len({k for k, _, _ in got}) == 6


def test_bursts_give_one_run_and_one_rerun():
    state = {"due": None, "pending": 0, "running": False, "queued": 0}
    runs = []
    for at, kind in [(0, "trigger"), (1, "trigger"), (2, "trigger"), (6, "trigger"), (7, "trigger"), (20, "trigger"), (30, "done"), (31, "done"), (40, "trigger")]:
        runs += freshness.step(state, at, kind, 3)
    assert runs == [(5, 3), (30, 3)] and freshness.advance(state, 100, 3) == [(43, 1)]


def test_quiet_periods_in_parallel(spark):
    rng = random.Random(3)
    times = sorted({rng.randrange(0, 400_000) for _ in range(1500)} | set(range(200_000, 203_000, 7)) | {10**7})
    events = spark.createDataFrame([(T + timedelta(seconds=t),) for t in times for _ in range(1 + t % 2)] + [(None,)], "ts timestamp")
    want, start, last, n = [], None, None, 0
    for t in times:
        if last is None or t - last >= 180:
            want += [(start, last + 180, n)] if last is not None else []
            start, n = t, 0
        last, n = t, n + 1 + t % 2
    want.append((start, last + 180, n))
    got = sorted(((r.first_ts - T).total_seconds(), (r.quiet_ts - T).total_seconds(), r.events) for r in freshness.quiet_periods(events).collect())
    assert got == want
    assert freshness.quiet_periods(events.limit(0)).count() == 0


def test_long_tails_are_spread(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(4000)] + [(10.0 ** (5 + i % 200),) for i in range(300)] + [(None,)], "v double")
    sizes = [r["count"] for r in in_ranges(rows.where("v IS NOT NULL"), "v").groupBy("_range").count().collect()]
    assert max(sizes) <= 5 * sum(sizes) / 256 and len(sizes) > 200
    exact = sorted(r.v for r in rows.where("v IS NOT NULL").collect())
    got = {r.p: r.value for r in usage.floor_percentile(rows, "v", [0, 1, 50, 95, 99, 100]).collect()}
    assert got == {p: exact[min(len(exact) - 1, p * len(exact) // 100)] for p in (0, 1, 50, 95, 99, 100)}


def test_unlinked(spark):
    seen, now = (spark.createDataFrame(r, "path string, hash string") for r in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {(r.path, r.action) for r in freshness.unlinked(seen, now).collect()} == {("b", "change"), ("c", "unlink"), ("d", "add")}


def test_mean_latency(spark):
    events = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "endpoint string, duration_ms double")
    assert [tuple(r) for r in usage.mean_latency(events).collect()] == [(2, 1.5)]
    assert {tuple(r) for r in usage.mean_latency(events, ["endpoint"]).collect()} == {("a", 2, 1.5)}
