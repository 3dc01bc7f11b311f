"""Queries over usage events and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import route_of
from ..functions.vocab import TRACKED_ROUTES
from ..operators import usage
from ..sources import catalog
from ..sources.io import load

U = "WITH " + catalog.CTE["usage"]
SINCE = f"ts > TIMESTAMP '{catalog.AS_OF}' - INTERVAL 30 DAYS"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _recent(spark, sf_dir):
    events = catalog.usage_events(spark, sf_dir)
    return events.where(usage.since(F.col("ts"), catalog.AS_OF, 30))


@query(f"{U} SELECT endpoint, count(*) AS calls, round(avg(duration_ms)) AS avg_ms, count(*) FILTER (WHERE status >= 400) AS errors FROM usage WHERE {SINCE} GROUP BY endpoint")
def stats_by_endpoint(spark, sf_dir):
    return usage.by_endpoint(_recent(spark, sf_dir))


@query(f"{U} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS calls FROM usage WHERE {SINCE} GROUP BY 1")
def stats_by_day(spark, sf_dir):
    return usage.by_day(_recent(spark, sf_dir))


@query(f"{U} SELECT agent, count(*) AS calls FROM usage WHERE agent IS NOT NULL AND {SINCE} GROUP BY agent")
def stats_by_agent(spark, sf_dir):
    return usage.by_agent(_recent(spark, sf_dir))


@query(f"{U} SELECT count(*) AS calls, count(*) FILTER (WHERE method = 'GET') AS reads, count(*) FILTER (WHERE method <> 'GET') AS writes, min(ts) AS first_ts FROM usage WHERE {SINCE}")
def stats_totals(spark, sf_dir):
    return usage.totals(_recent(spark, sf_dir))


@query(f"""SELECT event_id, ts, event_id % 4 = 0 AS is_new FROM events WHERE ts > TIMESTAMP '{catalog.AS_OF}' - INTERVAL 7 DAYS ORDER BY ts DESC, event_id LIMIT 200""")
def changes_recent(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    return usage.changes(rows, catalog.AS_OF, 7, 200, tie="event_id").select("event_id", F.col("updated_at").alias("ts"), "is_new")


@query("""SELECT path, edit_id, ts FROM (SELECT 'p' || user_id AS path, event_id AS edit_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
    FROM events WHERE event_type <> 'error') WHERE n = 1""")
def history_latest_edit(spark, sf_dir):
    edits = load(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("edit_id"), "ts", F.when(F.col("event_type") == "error", F.col("ts")).alias("reverted_at"))
    return usage.latest_edits(edits, ts="ts").select("path", "edit_id", "ts")


@query("""SELECT path, status, updated_at FROM (SELECT 'agents/a' || user_id || '/' || event_id || '.md' AS path,
    CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'promoted' END AS status, ts AS updated_at FROM events)
    WHERE status = 'proposed' ORDER BY updated_at DESC, path LIMIT 30""")
def proposals_queue(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    path = F.concat(F.lit("agents/a"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".md"))
    docs = load(spark, sf_dir, "events").select(path.alias("path"), F.when(k == 0, "proposed").when(k == 1, "promoted").alias("status"), F.col("ts").alias("updated_at"))
    return usage.proposals(docs)


@query("""SELECT route, count(*) AS n FROM (SELECT CASE WHEN p IN ({routes}) THEN p WHEN regexp_full_match(p, '/entity/[^/]+') THEN '/entity/:id' END AS route
    FROM (SELECT split_part(CASE page_id % 4 WHEN 0 THEN '/search?q=' || url WHEN 1 THEN '/entity/' || page_id WHEN 2 THEN '/note/update' ELSE url END, '?', 1) AS p FROM pages)) WHERE route IS NOT NULL GROUP BY route""".replace("{routes}", ", ".join(f"'{r}'" for r in TRACKED_ROUTES)))
def backlog_import_routes(spark, sf_dir):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/search?q="), "url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/entity/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 4 == 2, "/note/update").otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select(route_of(url, TRACKED_ROUTES).alias("route")).where("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("n"))


@query("""SELECT p, v AS value FROM (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events) t
    JOIN (SELECT unnest([50, 90, 95, 99]) AS p) q ON k = least(n - 1, CAST(floor(p * n / 100) AS BIGINT))""")
def percentile_floor(spark, sf_dir):
    return usage.floor_percentile(load(spark, sf_dir, "events"), "value", [50, 90, 95, 99])


@query("SELECT (SELECT count(*) FROM labels) AS indexed, (SELECT count(*) FROM documents) AS total, greatest(0, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels)) AS pending")
def index_coverage(spark, sf_dir):
    return usage.coverage(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents"))


@query(f"""{catalog.ctes('usage')} SELECT endpoint, count(*) AS calls, round(avg(duration_ms), 1) AS mean_ms FROM usage WHERE duration_ms IS NOT NULL GROUP BY endpoint""")
def mean_latency(spark, sf_dir):
    return usage.mean_latency(catalog.usage_events(spark, sf_dir), ["endpoint"])
