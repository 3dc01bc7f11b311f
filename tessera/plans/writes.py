"""Queries over the next snapshots: upserts, replacements, cascades, promotions, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, extract, index, lookup, store
from ..sources import catalog
from ..sources.io import load, new_path
from ..sources.tables import Tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, 'first' AS created FROM orders
    UNION ALL SELECT -1 - s_suppkey, 'new', 'second' FROM supplier""")
def snapshot_upsert(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    old = o.select("path", F.lit("old").alias("v"), F.lit("first").alias("created"))
    fresh = o.where("path % 3 = 0").unionByName(load(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("path"))).select("path", F.lit("new").alias("v"), F.lit("second").alias("created"))
    return index.upsert(old, fresh, ["path"], ["created"])


@query("""SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, 'old' AS content FROM lineitem WHERE l_orderkey % 5 <> 0
    UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def chunk_replace(spark, sf_dir):
    old = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.lit("old").alias("content"))
    new = load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("new").alias("content"))
    owners = load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("document_id"))
    return index.replace_of(old, new, owners, "document_id")


@query(f"""{catalog.ctes('vertices', 'edges')}, dead AS (SELECT entity_id FROM vertices WHERE document_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 4) AND type = 'Service')
    SELECT 'entities' AS what, (SELECT count(*) FROM vertices WHERE type = 'Service' AND entity_id NOT IN (SELECT * FROM dead)) AS n
    UNION ALL SELECT 'relations', count(*) FROM edges WHERE src NOT IN (SELECT * FROM dead) AND dst NOT IN (SELECT * FROM dead)""")
def delete_cascade(spark, sf_dir):
    v = catalog.vertices(spark, sf_dir).where("type = 'Service'")
    e = catalog.edges(spark, sf_dir).select(F.col("src").alias("source_entity_id"), F.col("dst").alias("target_entity_id"), F.col("type").alias("relation_type"), F.lit(None).cast("long").alias("origin_document_id"))
    gone = v.where("document_id % 10 = 4").select("document_id")
    out = index.delete_documents(gone, v, v, v, e)
    one = lambda k: out[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n")
    return one("entities").unionByName(one("relations"))


@query("""SELECT p_partkey AS note, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 3 = 1 THEN 'placeholder' ELSE 'fresh' END AS how FROM part""")
def entity_adopt(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    own = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("own"), key).alias("entity_id"), F.lit("Note").alias("type"), F.concat(F.lit("was"), key).alias("name"), k.alias("document_id"), F.lit("{}").alias("metadata"))
    blank = p.where("p_partkey % 3 = 1").select(F.concat(F.lit("placeholder"), key).alias("entity_id"), F.lit("Note").alias("type"), F.concat(F.lit("n"), key).alias("name"), F.lit(None).cast("long").alias("document_id"), F.lit("{}").alias("metadata"))
    notes = p.select(k.alias("document_id"), F.lit("Idea").alias("type"), F.concat(F.lit("n"), key).alias("name"), F.lit("{}").alias("metadata"))
    out = index.adopt_entities(own.unionByName(blank), notes)
    return out.select(F.col("document_id").alias("note"), F.coalesce(F.nullif(F.regexp_extract("entity_id", "^(own|placeholder)", 1), F.lit("")), F.lit("fresh")).alias("how"))


@query("""WITH links AS (SELECT DISTINCT l_suppkey AS s, 'part' || (l_partkey % 40) AS target FROM lineitem),
    known AS (SELECT DISTINCT 'part' || p_partkey AS name FROM part)
    SELECT 'edges' AS what, count(*) AS n FROM links UNION ALL SELECT 'placeholders', count(DISTINCT target) FROM links WHERE target NOT IN (SELECT name FROM known)
    UNION ALL SELECT 'kept', count(*) FROM supplier""")
def relations_sync(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    links = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_entity_id"), F.lit("MENTIONS").alias("relation_type"), F.concat(F.lit("part"), (F.col("l_partkey") % 40).cast("string")).alias("target"))
    p = load(spark, sf_dir, "part")
    entities = p.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("Note").alias("type"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("document_id"), F.lit("{}").alias("metadata"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_entity_id"), F.lit("e1").alias("target_entity_id"))
    row = lambda kind, origin: s.select("source_entity_id", "target_entity_id", F.lit(kind).alias("relation_type"), F.lit(1.0).cast("float").alias("confidence"), F.lit(origin).cast("string").alias("origin_document_id"))
    relations = row("USES", None).unionByName(row("SUPPORTS", "d1"))
    sources = s.select(F.col("source_entity_id").alias("entity_id"))
    rels, ents = index.sync_relations(relations, entities, links, sources)
    edges = rels.where("relation_type = 'MENTIONS'").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")
    kept = rels.where("relation_type != 'MENTIONS'").agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n")
    blank = ents.join(entities.select("entity_id"), "entity_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("placeholders").alias("what"), "n")
    return edges.unionByName(blank).unionByName(kept)


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS d, upper(l_shipmode) AS s, 'Part' || (l_partkey % 7) AS t FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'air' WHEN 1 THEN 'ship' ELSE 'ghost' END AS l_shipmode FROM lineitem))
    SELECT DISTINCT 'e-' || lower(s) AS source_entity_id, 'e-' || lower(t) AS target_entity_id, 'USES' AS relation_type FROM r WHERE s <> 'GHOST' AND t <> 'Part6'""")
def semantic_edges(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    mode = F.when(F.col("l_linenumber") % 3 == 0, "AIR").when(F.col("l_linenumber") % 3 == 1, "SHIP").otherwise("GHOST")
    relations = li.select(F.col("l_orderkey").alias("document_id"), mode.alias("source"), F.concat(F.lit("Part"), (F.col("l_partkey") % 7).cast("string")).alias("target"), F.lit("USES").alias("type"))
    names = relations.select("document_id", F.col("source").alias("name")).unionByName(relations.select("document_id", F.col("target").alias("name"))).distinct().where("name NOT IN ('GHOST', 'Part6')")
    return extract.semantic_edges(relations, names.withColumn("entity_id", F.concat(F.lit("e-"), F.lower("name"))))


@query("""WITH said AS (SELECT DISTINCT l_suppkey AS d, l_partkey % 50 AS k FROM lineitem),
    ent AS (SELECT d, k, CASE WHEN k < 25 THEN 'e' || k ELSE sha256('entity:Topic:topic/' || k) END AS e FROM said),
    edge AS (SELECT e AS source_entity_id, 's' || d AS target_entity_id, 'EXTRACTED_FROM' AS relation_type, d FROM ent WHERE d % 2 = 0
        UNION ALL SELECT e, 's' || d, 'USES', d FROM ent WHERE d % 2 = 0
        UNION ALL SELECT a.e, b.e, 'RELATES_TO', a.d FROM ent a JOIN ent b ON a.d = b.d AND b.k = (a.k + 1) % 50)
    SELECT source_entity_id, target_entity_id, relation_type, arg_min(d::VARCHAR, CASE WHEN d % 4 = 0 THEN 'agents/' ELSE 'notes/' END || d) AS origin FROM edge GROUP BY ALL
    UNION ALL SELECT 's1', 's' || s_suppkey, 'MENTIONS', NULL FROM supplier""")
def store_extraction(spark, sf_dir):
    """Suppliers as documents, the parts of their lines as what was extracted; edges that came from them before go, others stay."""
    s, text = load(spark, sf_dir, "supplier"), lambda c: F.col(c).cast("string")
    docs = s.select(text("s_suppkey").alias("document_id"), F.concat(F.when(F.col("s_suppkey") % 4 == 0, "agents/").otherwise("notes/"), text("s_suppkey")).alias("path"), F.col("s_name").alias("title"), F.sha2("s_name", 256).alias("content_hash"))
    note = s.select(F.concat(F.lit("s"), text("s_suppkey")).alias("entity_id"), F.lit("Service").alias("type"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, text("s_suppkey")).alias("document_id"))
    old = load(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("k")).distinct().select(F.concat(F.lit("e"), text("k")).alias("entity_id"), F.lit("Topic").alias("type"), F.concat(F.lit("topic-"), text("k")).alias("name"), F.lit(None).cast("string").alias("document_id"))
    rest = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("summary", "string"), ("confidence", "double"), ("sources", "array<string>"), ("origin", "string"))]
    edge = lambda kind, made: s.select(F.lit("s1").alias("source_entity_id"), F.concat(F.lit("s"), text("s_suppkey")).alias("target_entity_id"), F.lit(kind).alias("relation_type"), F.lit(1.0).alias("confidence"), made.cast("string").alias("origin_document_id"))
    tables = Tables(spark, new_path(spark, "tables"))
    none = spark.createDataFrame([], store.STATE)
    tables.commit({"entities": note.unionByName(old).select("*", *rest), "relations": edge("MENTIONS", F.lit(None)).unionByName(edge("CALLS_HTTP", F.col("s_suppkey"))), "extraction_state": none})
    topic = lambda k: F.concat(F.lit("topic/"), k.cast("string"))
    said = load(spark, sf_dir, "lineitem").select(text("l_suppkey").alias("document_id"), (F.col("l_partkey") % 50).alias("k")).distinct().join(docs, "document_id")
    thing = F.struct(F.lit("Topic").alias("type"), topic(F.col("k")).alias("name"), F.lit("a part").alias("summary"), F.lit(0.5).alias("confidence"))
    to = lambda name, kind: F.struct(topic(F.col("k")).alias("source"), name.alias("target"), F.lit(kind).alias("type"), F.lit(0.5).alias("confidence"))
    links = F.array(to(F.upper("title"), "USES"), to(topic((F.col("k") + 1) % 50), "RELATES_TO"), to(F.lit("nobody"), "USES"))
    got = said.groupBy("document_id").agg(F.sort_array(F.collect_list(thing)).alias("objects"), F.flatten(F.collect_list(links)).alias("relations"))
    store.store_extraction(tables, docs, got, "model", catalog.AS_OF)
    return tables.read("relations").select("source_entity_id", "target_entity_id", "relation_type", F.col("origin_document_id").alias("origin"))


_ASKED = ["src3/7.md", "src1/1", "SRC0/", "no such note"]


@query(f"""{catalog.ctes('docs')}, asked AS (SELECT unnest({_ASKED}) AS q) SELECT q, document_id, path FROM (SELECT q, document_id, path, row_number() OVER (PARTITION BY q ORDER BY
    CASE WHEN lower(path) = lower(q) THEN 1 WHEN contains(lower(path), lower(q)) THEN 2 WHEN lower(title) = lower(q) THEN 3 ELSE 4 END, length(path), path) AS n
    FROM docs JOIN asked ON contains(lower(path), lower(q)) OR contains(lower(title), lower(q))) WHERE n = 1""")
def note_lookup(spark, sf_dir):
    d = catalog.documents(spark, sf_dir)
    none = spark.createDataFrame([], "entity_id string, name string, document_id long")
    return lookup.find_note(d, none, spark.createDataFrame([(q,) for q in _ASKED], "q string")).drop("how")


@query("SELECT 's' || s_suppkey AS entity_id, s_name AS name FROM supplier WHERE contains(lower(s_name), '#00000001') ORDER BY s_name, 1 LIMIT 20")
def entity_list(spark, sf_dir):
    return lookup.entity_list(catalog.vertices(spark, sf_dir).where("type = 'Service'"), "#00000001").select("entity_id", "name")


@query("""SELECT c_custkey AS edit_id, CASE WHEN rn = 1 AND c_custkey % 11 <> 0 AND kind <> 'promote' THEN 'me' WHEN c_custkey % 11 = 0 THEN 'them' END AS reverted_by FROM (
    SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 11 = 0 ORDER BY c_acctbal DESC, c_custkey DESC) AS rn FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'promote' ELSE 'replace' END AS kind FROM customer))""")
def undo_latest(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    gone = F.col("c_custkey") % 11 == 0
    log = c.select(
        F.col("c_custkey").alias("edit_id"), F.col("c_nationkey").alias("path"), F.when(F.col("c_custkey") % 4 == 0, "promote").otherwise("replace").alias("edit_kind"), F.col("c_acctbal").alias("created_at"),
        F.when(gone, F.lit("2024-01-01").cast("timestamp")).alias("reverted_at"), F.when(gone, "them").alias("reverted_by"),
    )
    return audit.undo(log, "me", catalog.AS_OF).select("edit_id", "reverted_by")


@query("""SELECT event_id AS note_id, 'agents/' || event_type || CASE WHEN rn + (event_type = 'view')::INT > 1 THEN '-' || (rn + (event_type = 'view')::INT) ELSE '' END || '.md' AS path
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)""")
def free_paths(spark, sf_dir):
    notes = load(spark, sf_dir, "events").select(F.col("event_id").alias("note_id"), F.lit("agents").alias("folder"), F.col("event_type").alias("title"))
    return audit.free_paths(notes, spark.createDataFrame([("agents/view.md",)], "path string")).select("note_id", "path")
