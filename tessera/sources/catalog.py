"""The driver's tables as this engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import load

#: No query reads the clock: this is "now".
AS_OF = "2024-01-31 00:00:00"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, path, title, content, folder, lang."""
    title = F.trim(F.substring(F.regexp_extract("text", r"^([^.\n]*)", 1), 1, 90))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        title.alias("title"), F.col("text").alias("content"), F.col("source").alias("folder"), "lang",
    )


def chunks(spark: SparkSession, sf_dir: str, chars: int = 1500) -> DataFrame:
    """chunk_id, document_id, chunk_index, content: windows of 1,500 characters (the texts have neither headings nor paragraphs)."""
    docs = documents(spark, sf_dir).select("document_id", "content")
    last = F.greatest(F.lit(0), F.floor((F.length("content") - 1) / chars).cast("int"))
    each = docs.select("document_id", "content", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return each.select(
        (F.col("document_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index",
        F.substring(F.col("content"), F.col("chunk_index") * chars + 1, F.lit(chars)).alias("content"),
    )


_INDEXES: dict[tuple[str, str], object] = {}


def search_index(spark: SparkSession, sf_dir: str):
    """The search index of the tables; each part is made at the first search of a session that reads it."""
    from ..operators import postings

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = postings.search_index(chunks(spark, sf_dir), documents(spark, sf_dir))
    return _INDEXES[key]


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, endpoint, method, status, duration_ms, agent from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("ts"), F.col("event_type").alias("endpoint"), F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST").alias("method"),
        F.when(k % 7 == 0, 500).when(k % 5 == 0, 404).otherwise(200).alias("status"), F.col("value").cast("double").alias("duration_ms"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("agent-"), (F.col("user_id") % 10).cast("string"))).alias("agent"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, type, name, document_id of the supply graph."""
    def of(table, key, name, kind, letter):
        return load(spark, sf_dir, table).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.col(key).cast("long").alias("document_id"))

    out = of("supplier", "s_suppkey", "s_name", "Service", "s")
    for args in (("part", "p_partkey", "p_name", "Topic", "p"), ("customer", "c_custkey", "c_name", "Project", "c"), ("nation", "n_nationkey", "n_name", "BoundedContext", "n"), ("region", "r_regionkey", "r_name", "BoundedContext", "r")):
        out = out.unionByName(of(*args))
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Src, dst, type: BELONGS_TO (supplier, nation, region), PUBLISHES_TO (supplier to part), SUBSCRIBES_TO (customer to part), CALLS_HTTP (suppliers of one nation)."""
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    belongs = s.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("BELONGS_TO").alias("type")).unionByName(
        n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("BELONGS_TO").alias("type"))
    )
    # Distinct by their numbers: what is shuffled has no text.
    pubs = li.select("l_suppkey", "l_partkey").distinct().select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("PUBLISHES_TO").alias("type"))
    subs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct().select(key("c", "o_custkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("SUBSCRIBES_TO").alias("type"))
    calls = s.select(key("s", "s_suppkey").alias("src"), F.concat(F.lit("s"), (F.col("s_suppkey") % 50 + 1).cast("string")).alias("dst"), F.lit("CALLS_HTTP").alias("type")).where("src != dst")
    return belongs.unionByName(pubs).unionByName(subs).unionByName(calls)


#: Kinds of nodes in ``edge_numbers``: a node's number is its key times 8 and the place of its letter.
LETTERS = "spcnr"


def node_number(letter: str, key: str):
    return F.col(key).cast("long") * 8 + LETTERS.index(letter)


def edge_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``edges`` with numbers for src and dst; some repeat."""
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    of = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    supplier = node_number("s", "s_suppkey")
    out = of(s, supplier, node_number("n", "s_nationkey"), "BELONGS_TO").unionByName(of(n, node_number("n", "n_nationkey"), node_number("r", "n_regionkey"), "BELONGS_TO"))
    out = out.unionByName(of(li, node_number("s", "l_suppkey"), node_number("p", "l_partkey"), "PUBLISHES_TO"))
    out = out.unionByName(of(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), node_number("c", "o_custkey"), node_number("p", "l_partkey"), "SUBSCRIBES_TO"))
    return out.unionByName(of(s, supplier, (F.col("s_suppkey") % 50 + 1) * 8 + LETTERS.index("s"), "CALLS_HTTP").where("src != dst"))


#: The same tables in DuckDB, as common table expressions.
CTE = {
    "docs": r"""docs AS (SELECT doc_id AS document_id, source || '/' || doc_id || '.md' AS path,
        trim(substr(regexp_extract(text, '^([^.\n]*)', 1), 1, 90)) AS title, text AS content, source AS folder, lang FROM documents)""",
    "chunks": """chunks AS (SELECT document_id * 100000 + i AS chunk_id, document_id, i AS chunk_index, substr(content, i * 1500 + 1, 1500) AS content
        FROM (SELECT document_id, content, unnest(range(0, greatest(1, (length(content) + 1499) // 1500))) AS i FROM docs))""",
    "usage": """usage AS (SELECT event_id, ts, event_type AS endpoint, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
        CASE WHEN k % 7 = 0 THEN 500 WHEN k % 5 = 0 THEN 404 ELSE 200 END AS status, value AS duration_ms,
        CASE WHEN user_id % 3 <> 0 THEN 'agent-' || (user_id % 10) END AS agent
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "vertices": """vertices AS (SELECT 's' || s_suppkey AS entity_id, 'Service' AS type, s_name AS name, s_suppkey AS document_id FROM supplier
        UNION ALL SELECT 'p' || p_partkey, 'Topic', p_name, p_partkey FROM part UNION ALL SELECT 'c' || c_custkey, 'Project', c_name, c_custkey FROM customer
        UNION ALL SELECT 'n' || n_nationkey, 'BoundedContext', n_name, n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'BoundedContext', r_name, r_regionkey FROM region)""",
    "edges": """edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'BELONGS_TO' AS type FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'BELONGS_TO' FROM nation
        UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'PUBLISHES_TO' FROM lineitem
        UNION ALL SELECT DISTINCT 'c' || o_custkey, 'p' || l_partkey, 'SUBSCRIBES_TO' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey % 50 + 1), 'CALLS_HTTP' FROM supplier WHERE s_suppkey <> s_suppkey % 50 + 1)""",
}


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(CTE[n] for n in names)
