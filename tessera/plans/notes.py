"""Queries over notes: parsing, incremental state, extraction, duplicates, hygiene, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import centroids
from ..operators import dedup, extract, hygiene, index, notes
from ..sources import catalog
from ..sources.io import load, new_path
from ..streaming import freshness

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _markdown(spark, sf_dir):
    """Pages as notes: the heading becomes a level-one heading, anchors become wiki links."""
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<h1[^>]*>(.*?)</h1>", "\n# $1\n"), r"(?s)<a [^>]*>(.*?)</a>", "[[$1]]")
    return load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("technologies/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), html.alias("body"))


MD = r"""md AS (SELECT page_id, 'technologies/' || page_id || '.md' AS path, regexp_replace(regexp_replace(html, '<h1[^>]*>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'gs'), '<a [^>]*>(.*?)</a>', '[[\1]]', 'gs') AS body FROM pages)"""


@query(rf"WITH {MD} SELECT page_id, coalesce(nullif(trim(regexp_extract(body, '(?m)^#\s+(.+)$', 1)), ''), page_id::VARCHAR) AS title FROM md")
def parse_title(spark, sf_dir):
    md = _markdown(spark, sf_dir)
    return md.select("page_id", F.coalesce(notes.heading_title(F.col("body")), notes.basename(F.col("path"))).alias("title"))


@query(rf"WITH {MD} SELECT DISTINCT page_id, 'MENTIONS' AS type, trim(t) AS target FROM (SELECT page_id, unnest(regexp_extract_all(body, '\[\[([^\]|#]+)[^\]]*\]\]', 1)) AS t FROM md) WHERE trim(t) <> ''")
def parse_links(spark, sf_dir):
    md = _markdown(spark, sf_dir).select("page_id", F.explode(notes.links_of(F.col("body"), F.lit("{}"), F.lit(""))).alias("l"))
    return md.select("page_id", "l.type", "l.target")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Project' WHEN 2 THEN 'Technology' WHEN 3 THEN 'Agent' ELSE 'Note' END AS type FROM documents""")
def parse_type(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    folder = F.when(k == 1, "projects/x").when(k == 2, "a/Technologies").when(k == 3, "agents/bot").otherwise("elsewhere")
    return d.select("doc_id", notes.note_type(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), F.when(k == 0, "dECISION").otherwise("unheard of")).alias("type"))


@query(f"""{catalog.ctes('docs')} SELECT document_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'untitled') AS slug FROM docs""")
def slugify(spark, sf_dir):
    return catalog.documents(spark, sf_dir).select("document_id", text.slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def _sections_of(spark, sf_dir):
    """Conversations as documents: every turn is a section, every user's turn that asks again is a correction."""
    c = load(spark, sf_dir, "conversations")
    head = F.when(F.col("turn") % 3 == 2, "## Correction: turn ").otherwise("## Turn ")
    turn = F.concat(head, F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", r"\s+", " "))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))), lambda s: s["t"]), "\n").alias("body"))


@query("""SELECT conv_id, CAST(row_number() OVER w - 1 AS INT) AS section, coalesce(max(turn % 3 = 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS superseded
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_sections(spark, sf_dir):
    return notes.sections(_sections_of(spark, sf_dir), "conv_id", "body").select("conv_id", "section", "superseded")


@query()
def chunk_hard_split(spark, sf_dir):
    """Rows only: cutting at the last space is sequential, and DuckDB has no such function; the chunker is tested by hand."""
    docs = catalog.documents(spark, sf_dir).select("document_id", F.col("content").alias("body"))
    return notes.chunk_documents(docs).select("document_id", "chunk_index", F.length("content").alias("chars"), "superseded")


@query("SELECT document_id FROM (SELECT doc_id AS document_id, sha256(text) AS h, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN 'old' END AS last_hash FROM documents) WHERE last_hash IS NULL OR last_hash <> h")
def incremental_select(spark, sf_dir):
    d = catalog.documents(spark, sf_dir).select(F.col("document_id").cast("string").alias("path"), "document_id", F.sha2("content", 256).alias("content_hash"))
    k = F.col("document_id") % 3
    state = d.where(k != 2).select("path", F.when(k == 0, F.col("content_hash")).otherwise("old").alias("last_hash"))
    return index.changed(d, state).select("document_id")


@query("SELECT 'd' || doc_id AS path FROM documents WHERE doc_id % 10 = 3")
def prune_missing(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    return index.removed(d.select("path"), d.where("doc_id % 10 != 3"))


@query("""WITH e AS (SELECT p_name AS name, min(p_partkey) FILTER (WHERE p_partkey % 2 = 0) AS backed, min(p_partkey) AS least FROM part GROUP BY p_name),
    l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'nobody' ELSE p_name END AS target FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, coalesce(backed, least) AS entity_id FROM l LEFT JOIN e ON target = name""")
def link_resolution(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("document_id"))
    li = load(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    links = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "nobody").otherwise(F.col("p_name")).alias("target"))
    return index.resolve_links(links, e).select("l_orderkey", "l_linenumber", F.col("target_entity_id").alias("entity_id"))


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id % 4 IN (1, 2)")
def extraction_pending(spark, sf_dir):
    d = catalog.documents(spark, sf_dir).select("document_id", "path", F.sha2("content", 256).alias("content_hash"))
    k = F.col("document_id") % 4
    state = d.where(k != 1).select("document_id", F.when(k == 2, "old").otherwise(F.col("content_hash")).alias("last_hash"))
    return extract.pending(d, state).select("document_id")


@query("""WITH o AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'x-' || s_name ELSE 'part/' || s_suppkey END AS name, 'Service' AS type FROM supplier),
    e AS (SELECT 's' || s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'Service' ELSE 'Topic' END AS etype, s_name AS ename, s_suppkey % 5 = 0 AS doc FROM supplier),
    m AS (SELECT name, type, id, row_number() OVER (PARTITION BY name ORDER BY doc DESC, (lower(ename) = lower(replace(name, '/', '-'))) DESC, (etype = type) DESC, id) AS n
      FROM o JOIN e ON lower(ename) = lower(replace(name, '/', '-')) OR ends_with(lower(ename), '-' || lower(replace(name, '/', '-'))) OR ends_with(lower(replace(name, '/', '-')), '-' || lower(ename)))
    SELECT o.name, m.id AS entity_id FROM o LEFT JOIN m ON o.name = m.name AND n = 1""")
def entity_upsert(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    o = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("x-"), "s_name")).otherwise(F.concat(F.lit("part/"), k)).alias("name"), F.lit("Service").alias("type")).distinct()
    e = s.select(F.concat(F.lit("s"), k).alias("entity_id"), F.when(F.col("s_suppkey") % 2 == 0, "Service").otherwise("Topic").alias("type"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey")).alias("document_id"))
    return extract.match_entities(o, e).select("name", "entity_id")


@query("""SELECT c_custkey, array_to_string([CASE WHEN c_custkey % 4 = 0 THEN 'notes/moved.md' ELSE 'agents/a.md' END, CASE WHEN c_custkey % 3 = 0 THEN 'projects/p.md' ELSE 'agents/b.md' END], ',') AS sources,
    CASE WHEN c_custkey % 4 = 0 THEN 'human' ELSE 'unset' END AS origin FROM customer""")
def origin_flip(spark, sf_dir):
    k = F.col("c_custkey")
    sources = F.array(F.when(k % 4 == 0, "agents/old.md").otherwise("agents/a.md"), F.when(k % 3 == 0, "projects/p.md").otherwise("agents/b.md"))
    e = load(spark, sf_dir, "customer").select("c_custkey", sources.alias("sources"), F.lit("unset").alias("origin"))
    return extract.repoint(e, "agents/old.md", "notes/moved.md").select("c_custkey", F.array_join("sources", ",").alias("sources"), "origin")


@query("""SELECT p_partkey FROM part WHERE p_partkey % 2 = 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def orphan_sweep(spark, sf_dir):
    e = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 2 == 1, "semantic").otherwise("note").alias("kind"), F.lit(None).cast("long").alias("document_id"))
    r = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_entity_id"), F.col("l_suppkey").alias("target_entity_id"))
    return extract.orphans(e, r).select(F.col("entity_id").alias("p_partkey"))


DIMS = 64
VECS = "v AS (SELECT vec_id // 2 AS id, " + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS x{i}" for i in range(DIMS)) + " FROM embeddings GROUP BY 1), u AS (SELECT id, [" + ", ".join(f"x{i}" for i in range(DIMS)) + "] AS vec FROM v)"
FOLD = "f AS (SELECT id, CASE id % 3 WHEN 0 THEN 'technologies' ELSE 'projects' END AS folder FROM u)"
PAIRS = f"""{VECS}, {FOLD}, p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vec, b.vec) AS sim FROM u a JOIN u b ON a.id < b.id AND list_cosine_similarity(a.vec, b.vec) > 0.3),
    k AS (SELECT a, b, sim, sim > greatest(0.3, CASE WHEN fa.folder = 'technologies' OR fb.folder = 'technologies' THEN 0.33 ELSE 0 END) AS kept FROM p JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b)"""


def _vectors(spark, sf_dir):
    return dedup.document_vectors(load(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 2).cast("long")), "doc", "embedding", DIMS)


def _pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    folders = v.select("id", F.concat(F.when(F.col("id") % 3 == 0, "technologies").otherwise("projects"), F.lit("/x.md")).alias("path"))
    return dedup.report_pairs(v, folders, 0.3, strict={"technologies": 0.33})


@query("SELECT label, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) AS c{i}" for i in range(0, 64, 16)) + " FROM embeddings GROUP BY label")
def dedup_centroids(spark, sf_dir):
    c = centroids(load(spark, sf_dir, "embeddings"), "label", "embedding", DIMS)
    return c.select("label", *[F.round(F.get("centroid", F.lit(i)), 6).alias(f"c{i}") for i in range(0, DIMS, 16)])


@query(f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim, kept FROM k")
def dedup_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("sim", 6).alias("sim"), "kept")


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (WHERE NOT kept) AS suppressed FROM k")
def dedup_suppressed(spark, sf_dir):
    return dedup.suppressed(_pairs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT count(*) AS pairs FROM p JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b WHERE sim > 0.31 AND fa.folder = 'projects' AND fb.folder = 'projects'")
def hygiene_near_duplicates(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    folders = v.select("id", F.concat(F.when(F.col("id") % 3 == 0, "technologies").otherwise("projects"), F.lit("/x.md")).alias("path"))
    return hygiene.near_duplicates(v, folders, 0.31)


CLUSTERS = f"""{PAIRS}, e AS (SELECT a, b, sim FROM k WHERE kept UNION ALL SELECT b, a, sim FROM k WHERE kept), r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
    c AS (SELECT id, min(seen) AS cluster FROM r GROUP BY id), m AS (SELECT id, cluster, first_value(id) OVER (PARTITION BY cluster ORDER BY (id * 7) % 11 DESC, id) AS canonical FROM c)"""


def _clusters(spark, sf_dir):
    updated = _vectors(spark, sf_dir).select("id", ((F.col("id") * 7) % 11).alias("updated_at"))
    return dedup.clusters(_pairs(spark, sf_dir), updated)


@query(f"WITH RECURSIVE {CLUSTERS} SELECT cluster, count(*) AS members, max(canonical) AS canonical FROM m GROUP BY cluster")
def dedup_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("members"), F.max("canonical").alias("canonical"))


@query(f"""WITH RECURSIVE {CLUSTERS} SELECT cluster, string_agg(DISTINCT CASE id % 3 WHEN 0 THEN 'technologies' WHEN 1 THEN 'projects/solution_designs' ELSE 'ideas' END, ' ↔ '
    ORDER BY CASE id % 3 WHEN 0 THEN 'technologies' WHEN 1 THEN 'projects/solution_designs' ELSE 'ideas' END) AS folders, count(*) AS size FROM m GROUP BY cluster""")
def dedup_order(spark, sf_dir):
    path = F.when(F.col("id") % 3 == 0, "technologies/x.md").when(F.col("id") % 3 == 1, "projects/solution_designs/y.md").otherwise("ideas/z.md")
    members = _clusters(spark, sf_dir)
    return dedup.ordered_clusters(members, members.select("id", path.alias("path")).distinct())


@query(f"WITH RECURSIVE {CLUSTERS} SELECT m.id, m.cluster, m.canonical, CASE WHEN m.id = m.canonical THEN 'canon' WHEN e.sim IS NOT NULL THEN 'direct' ELSE 'trans' END AS label FROM m LEFT JOIN e ON e.a = m.id AND e.b = m.canonical")
def dedup_members(spark, sf_dir):
    label = F.when(F.col("label").isin("canon", "trans"), F.col("label")).otherwise("direct")
    return _clusters(spark, sf_dir).select("id", "cluster", "canonical", label.alias("label"))


@query("""WITH p AS (SELECT CASE WHEN doc_id % 3 = 1 THEN 'n/' || (doc_id // 3) || '-2.md' ELSE 'n/' || (doc_id // 2) || '.md' END AS path FROM documents)
    SELECT path AS copy, regexp_replace(path, '-[0-9]+\\.md$', '.md') AS original FROM p WHERE regexp_matches(path, '-[0-9]+\\.md$') AND regexp_replace(path, '-[0-9]+\\.md$', '.md') IN (SELECT path FROM p)""")
def suffix_suspects(spark, sf_dir):
    k = F.col("doc_id")
    path = F.when(k % 3 == 1, F.concat(F.lit("n/"), F.floor(k / 3).cast("string"), F.lit("-2.md"))).otherwise(F.concat(F.lit("n/"), F.floor(k / 2).cast("string"), F.lit(".md")))
    return dedup.suffix_suspects(load(spark, sf_dir, "documents").select(path.alias("path"))).select("copy", "original")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def hygiene_counts(spark, sf_dir):
    return hygiene.table_counts({t: load(spark, sf_dir, t) for t in ("documents", "embeddings", "events")})


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN repeat('слово ', 20) || substr(text, 1, 60) ELSE text END AS t FROM documents),
    n AS (SELECT doc_id, length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) AS cyr, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS lat FROM d) SELECT doc_id FROM n WHERE cyr > 40 AND cyr / (cyr + lat) > 0.15""".replace("\\u0400", "Ѐ").replace("\\u04FF", "ӿ"))
def hygiene_language(spark, sf_dir):
    t = F.when(F.col("doc_id") % 50 == 0, F.concat(F.repeat(F.lit("слово "), F.lit(20)), F.substring("text", 1, 60))).otherwise(F.col("text"))
    return hygiene.foreign_notes(load(spark, sf_dir, "documents").select("doc_id", t.alias("content"))).select("doc_id")


@query(f"""SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AND ts <= TIMESTAMP '{catalog.AS_OF}' - INTERVAL 14 DAYS""")
def hygiene_stale_tasks(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    d = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "task").alias("kind"), F.when(k % 2 == 1, "done").when(k % 4 == 0, "open").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").cast("string").alias("path"))
    return hygiene.stale_tasks(d, catalog.AS_OF).select("event_id")


@query("""WITH e AS (SELECT event_type AS path, user_id % 5 AS action, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 SECONDS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts) AS n FROM e) SELECT path, min(ts) AS first_ts, max(ts) + INTERVAL 10 SECONDS AS quiet_ts, arg_max(action, ts) AS action, count(*) AS events FROM s GROUP BY path, n""")
def stream_debounce(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("path"), (F.col("user_id") % 5).alias("action"), "ts")
    return freshness.debounced(e, gap_ms=10_000)


@query("""WITH e AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 180 SECONDS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT ts, sum(new) OVER (ORDER BY ts) AS n FROM e)
    SELECT min(ts) AS first_ts, max(ts) + INTERVAL 180 SECONDS AS quiet_ts, count(*) AS events FROM s GROUP BY n""")
def stream_quiet_period(spark, sf_dir):
    return freshness.quiet_periods(load(spark, sf_dir, "events").select("ts"))


_ISSUES = """issues AS (SELECT user_id AS issue_id, ts, CASE WHEN event_type = 'purchase' THEN 'svc-' || (event_id % 12) END AS repo FROM events),
    first AS (SELECT issue_id, arg_min(repo, ts) AS repo, min(ts) AS ts FROM issues WHERE repo IS NOT NULL GROUP BY issue_id)"""


@query(f"""WITH {_ISSUES}, judged AS (SELECT *, CASE CAST(substr(repo, 5) AS INT) % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'empty' ELSE 'posted' END AS status FROM first)
    SELECT issue_id, status, repo, CASE status WHEN 'posted' THEN 'impact of ' || repo END AS comment, ts FROM judged""")
def stream_announce(spark, sf_dir):
    """Runs a real stream over the events' files to its end."""
    plain = load(spark, sf_dir, "events")
    live = spark.readStream.schema(plain.schema).parquet(f"{sf_dir}/events.parquet*")
    url = F.concat(F.lit("see https://github.com/acme/svc-"), (F.col("event_id") % 12).cast("string"), F.lit("/pull/7"))
    issues = live.select(F.col("user_id").alias("issue_id"), F.when(F.col("event_type") == "purchase", url).otherwise("nothing to link").alias("body"), F.col("ts").cast("timestamp").alias("ts"))
    repos = plain.select((F.col("event_id") % 12).alias("r")).distinct().where("r % 3 != 0").withColumn("repo", F.concat(F.lit("svc-"), F.col("r").cast("string")))
    comments = repos.select("repo", F.when(F.col("r") % 3 == 2, F.concat(F.lit("impact of "), "repo")).alias("comment"))
    done = freshness.run_through(freshness.announce(issues, comments), new_path(spark, "announce"))
    return done.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if dict(plain.dtypes)["ts"] == "timestamp_ntz" else done


@query()
def stream_single_flight(spark, sf_dir):
    """Runs a real stream: every user's clicks trigger, views end the run; one row for each run."""
    plain = load(spark, sf_dir, "events")
    live = spark.readStream.schema(plain.schema).parquet(f"{sf_dir}/events.parquet*").where("event_type IN ('click', 'view')")
    events = live.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "done").otherwise("trigger").alias("kind"))
    return freshness.run_through(freshness.single_flight(events), new_path(spark, "flight"))


@query("SELECT conv_id, CASE WHEN position('pull' IN text) > 0 THEN 1 ELSE 0 END AS has, CASE WHEN conv_id % 2 = 0 THEN 'repo-' || turn END AS repo FROM conversations")
def pull_request_repo(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    body = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("see [x](https://GitHub.com/acme/repo-"), F.col("turn").cast("string"), F.lit(".git/pull/12) "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", F.contains("text", F.lit("pull")).cast("int").alias("has"), text.pull_request_repo(body).alias("repo"))
