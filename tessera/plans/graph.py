"""Queries over the supply graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, search
from ..sources import catalog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ROOTS = "roots AS (SELECT entity_id FROM vertices WHERE type = 'Service')"


def _roots(spark, sf_dir):
    return catalog.vertices(spark, sf_dir).where("type = 'Service'").select("entity_id")


@query(f"{catalog.ctes('vertices')} SELECT type, count(*) AS n, count(DISTINCT name) AS names FROM vertices GROUP BY type")
def graph_vertices(spark, sf_dir):
    return catalog.vertices(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query(f"{catalog.ctes('edges')} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY type")
def graph_edges(spark, sf_dir):
    return catalog.edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def _hop_sql(hops: int, types: str = "") -> str:
    where = f" WHERE type IN ({types})" if types else ""
    steps = "".join(f", d{i} AS (SELECT * FROM d{i - 1} UNION SELECT root, both_.b FROM d{i - 1} JOIN both_ ON node = both_.a)" for i in range(1, hops))
    return f"""{catalog.ctes('vertices', 'edges')}, {ROOTS}, own AS (SELECT * FROM edges{where}),
        both_ AS (SELECT src AS a, dst AS b FROM own UNION SELECT dst, src FROM own), d0 AS (SELECT entity_id AS root, entity_id AS node FROM roots){steps},
        near AS (SELECT root, src, dst, type FROM own JOIN d{hops - 1} ON src = node UNION SELECT root, src, dst, type FROM own JOIN d{hops - 1} ON dst = node)
        SELECT root, type, count(*) AS n FROM near GROUP BY root, type"""


def _near(spark, sf_dir, hops, types=None):
    roots = catalog.load(spark, sf_dir, "supplier").select(catalog.node_number("s", "s_suppkey").alias("entity_id"))
    got = graph.neighbourhood_counts(catalog.edge_numbers(spark, sf_dir), roots, hops, types)
    return got.select(F.concat(F.lit("s"), F.shiftright("root", 3).cast("string")).alias("root"), "type", "n")


@query(_hop_sql(1))
def neighborhood_1(spark, sf_dir):
    return _near(spark, sf_dir, 1)


@query(_hop_sql(2))
def neighborhood_2(spark, sf_dir):
    return _near(spark, sf_dir, 2)


@query(_hop_sql(3, "'PUBLISHES_TO', 'BELONGS_TO'"))
def neighborhood_3(spark, sf_dir):
    return _near(spark, sf_dir, 3, ["PUBLISHES_TO", "BELONGS_TO"])


@query(_hop_sql(3))
def neighborhood_3_all(spark, sf_dir):
    return _near(spark, sf_dir, 3)


@query(_hop_sql(2, "'PUBLISHES_TO', 'SUBSCRIBES_TO'"))
def neighborhood_typed(spark, sf_dir):
    return _near(spark, sf_dir, 2, ["PUBLISHES_TO", "SUBSCRIBES_TO"])


@query(f"""{catalog.ctes('vertices', 'edges')}, {ROOTS} SELECT p.src AS entity_id, p.dst AS topic, coalesce(string_agg(DISTINCT s.src, ',' ORDER BY s.src), '') AS consumers, count(DISTINCT s.src) AS n_consumers
    FROM edges p JOIN roots ON p.src = entity_id LEFT JOIN edges s ON s.type = 'SUBSCRIBES_TO' AND s.dst = p.dst AND s.src <> p.src WHERE p.type = 'PUBLISHES_TO' GROUP BY p.src, p.dst""")
def impact_publishes(spark, sf_dir):
    return graph.publishes(catalog.edges(spark, sf_dir), _roots(spark, sf_dir))


@query(f"""{catalog.ctes('vertices', 'edges')}, {ROOTS}, o AS (SELECT src AS entity_id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS calls FROM edges JOIN roots ON src = entity_id WHERE type = 'CALLS_HTTP' GROUP BY src),
    i AS (SELECT dst AS entity_id, string_agg(DISTINCT src, ',' ORDER BY src) AS called_by FROM edges JOIN roots ON dst = entity_id WHERE type = 'CALLS_HTTP' GROUP BY dst),
    c AS (SELECT src AS entity_id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS contexts FROM edges JOIN roots ON src = entity_id WHERE type = 'BELONGS_TO' GROUP BY src)
    SELECT entity_id, calls, called_by, contexts FROM roots LEFT JOIN o USING (entity_id) LEFT JOIN i USING (entity_id) LEFT JOIN c USING (entity_id)""")
def impact_http(spark, sf_dir):
    edges, roots = catalog.edges(spark, sf_dir), _roots(spark, sf_dir)
    out = graph.related(edges, roots, "CALLS_HTTP").withColumnRenamed("names", "calls")
    back = graph.related(edges, roots, "CALLS_HTTP", inbound=True).withColumnRenamed("names", "called_by")
    contexts = graph.related(edges, roots, "BELONGS_TO").withColumnRenamed("names", "contexts")
    return roots.join(out, "entity_id", "left").join(back, "entity_id", "left").join(contexts, "entity_id", "left")


@query(f"""{catalog.ctes('vertices', 'edges')}, {ROOTS}, sem AS (SELECT 'k' || l_orderkey || '-' || l_linenumber AS entity_id, CASE l_linenumber % 4 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Problem' WHEN 2 THEN 'Constraint' ELSE 'Claim' END AS type,
    's' || l_suppkey AS target, CASE l_linenumber % 2 WHEN 0 THEN 'USES' ELSE 'MENTIONS' END AS rel FROM lineitem)
    SELECT DISTINCT target, entity_id, type FROM sem WHERE rel = 'USES' AND type <> 'Claim' AND target IN (SELECT entity_id FROM roots)""")
def impact_attached(spark, sf_dir):
    li = catalog.load(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "Decision").when(F.col("l_linenumber") % 4 == 1, "Problem").when(F.col("l_linenumber") % 4 == 2, "Constraint").otherwise("Claim")
    own = F.concat(F.lit("k"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    rows = li.select(own.alias("entity_id"), kind.alias("type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "USES").otherwise("MENTIONS").alias("rel"))
    entities = rows.select("entity_id", "type", F.lit("semantic").alias("kind"), F.col("entity_id").alias("name"), F.lit(None).cast("string").alias("summary"), F.lit("human").alias("origin")).distinct()
    edges = rows.select(F.col("entity_id").alias("src"), "dst", F.col("rel").alias("type"))
    return graph.attached_knowledge(edges, entities, _roots(spark, sf_dir), cap=None).select("target", "entity_id", "type")


KNOWN = """sem AS (SELECT 'k' || l_orderkey || '-' || l_linenumber AS entity_id, CASE l_linenumber % 4 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Problem' WHEN 2 THEN 'Constraint' ELSE 'Claim' END AS type,
    'c' || o_custkey AS target, CASE l_linenumber % 2 WHEN 0 THEN 'USES' ELSE 'MENTIONS' END AS rel FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""{catalog.ctes('vertices', 'edges')}, {ROOTS}, {KNOWN},
    near AS (SELECT entity_id AS root, entity_id AS source, 0 AS far FROM roots UNION SELECT p.src, s.src, 1 FROM edges p JOIN edges s ON p.type = 'PUBLISHES_TO' AND s.type = 'SUBSCRIBES_TO' AND p.dst = s.dst AND p.src <> s.src JOIN roots ON p.src = entity_id)
    SELECT root, source, entity_id, type FROM (SELECT root, source, sem.entity_id, type, row_number() OVER (PARTITION BY root ORDER BY far, sem.entity_id, source) AS n
        FROM near JOIN (SELECT DISTINCT entity_id, type, target FROM sem WHERE rel = 'USES' AND type <> 'Claim') sem ON target = source) WHERE n <= 30""")
def impact_knowledge(spark, sf_dir):
    li, o = catalog.load(spark, sf_dir, "lineitem"), catalog.load(spark, sf_dir, "orders")
    k = F.col("l_linenumber") % 4
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("k"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"),
        F.when(F.col("l_linenumber") % 2 == 0, "USES").otherwise("MENTIONS").alias("type"), F.when(k == 0, "Decision").when(k == 1, "Problem").when(k == 2, "Constraint").otherwise("Claim").alias("kind"),
    )
    entities = rows.select(F.col("src").alias("entity_id"), F.col("kind").alias("type"), F.lit("semantic").alias("kind"), F.col("src").alias("name"), F.lit(None).cast("string").alias("summary"), F.lit("human").alias("origin")).distinct()
    edges = catalog.edges(spark, sf_dir).unionByName(rows.select("src", "dst", "type"))
    return graph.impact_knowledge(edges, entities, _roots(spark, sf_dir)).select("root", "source", "entity_id", "type")


@query(f"""{catalog.ctes('vertices', 'edges')}, old_nodes AS (SELECT entity_id, CASE WHEN document_id % 5 = 0 THEN name || ' (old)' ELSE name END AS name FROM vertices WHERE type <> 'Topic' OR document_id % 7 <> 0),
    now_nodes AS (SELECT entity_id, name FROM vertices WHERE NOT (type = 'Project' AND document_id % 11 = 0)), now_edges AS (SELECT DISTINCT e.* FROM edges e JOIN now_nodes a ON src = a.entity_id JOIN now_nodes b ON dst = b.entity_id),
    old_edges AS (SELECT * FROM edges WHERE type <> 'CALLS_HTTP')
    SELECT 'nodes' AS what, change, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT coalesce(o.entity_id, f.entity_id) AS id, CASE WHEN o.entity_id IS NULL THEN 'insert' WHEN f.entity_id IS NULL THEN 'delete' WHEN o.name <> f.name THEN 'update' END AS change
        FROM old_nodes o FULL JOIN now_nodes f ON o.entity_id = f.entity_id) WHERE change IS NOT NULL GROUP BY change
    UNION ALL SELECT 'edges', change, count(*), count(DISTINCT src) FROM (SELECT coalesce(o.src, f.src) AS src, CASE WHEN o.src IS NULL THEN 'insert' WHEN f.src IS NULL THEN 'delete' END AS change
        FROM old_edges o FULL JOIN now_edges f ON o.src = f.src AND o.dst = f.dst AND o.type = f.type) WHERE change IS NOT NULL GROUP BY change""")
def graph_projection(spark, sf_dir):
    v, e = catalog.vertices(spark, sf_dir), catalog.edges(spark, sf_dir)
    meta = F.lit(None).cast("struct<kind:string,origin:string,summary:string>").alias("metadata")
    docs = v.limit(0).select("document_id", F.col("name").alias("path"))
    shown = lambda rows: graph.project_nodes(rows.withColumn("metadata", meta), docs)
    stale = v.where("type != 'Topic' OR document_id % 7 != 0").withColumn("name", F.when(F.col("document_id") % 5 == 0, F.concat("name", F.lit(" (old)"))).otherwise(F.col("name")))
    now = v.where("NOT (type = 'Project' AND document_id % 11 = 0)").withColumn("metadata", meta)
    out = graph.project(shown(stale), e.where("type != 'CALLS_HTTP'"), now, docs, e)
    count = lambda k, i: out[k].groupBy("change").agg(F.count("*").alias("n"), F.countDistinct(i).alias("ids")).select(F.lit(k).alias("what"), "change", "n", "ids")
    return count("nodes", "entity_id").unionByName(count("edges", "src"))


_ASKED = ["supplier#000000007", "red", "supplier#000000001", "asia", "no such name", "ring"]


@query(f"""{catalog.ctes('vertices')}, asked AS (SELECT unnest({_ASKED}) AS q), k AS (SELECT *, replace(lower(name), '/', '-') AS nk FROM vertices)
    SELECT q, entity_id, type, name FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (nk = q) DESC, ends_with(nk, '-' || q) DESC, length(name), entity_id) AS n FROM k JOIN asked ON contains(nk, q)) WHERE n = 1""")
def resolve_entity(spark, sf_dir):
    return graph.resolve(catalog.vertices(spark, sf_dir), spark.createDataFrame([(q,) for q in _ASKED], "q string"))


@query(f"""{catalog.ctes('vertices', 'edges')}, e AS (SELECT * FROM edges), both_ AS (
    SELECT src AS entity_id, '- ' || e.type || ' -> ' || d.name AS line FROM e JOIN vertices d ON d.entity_id = dst JOIN vertices s ON s.entity_id = src
    UNION ALL SELECT dst, '- ' || e.type || ' <- ' || s.name FROM e JOIN vertices d ON d.entity_id = dst JOIN vertices s ON s.entity_id = src)
    SELECT entity_id, string_agg(line, chr(10) ORDER BY line) AS markdown, count(*) AS lines FROM both_ GROUP BY entity_id""")
def context_markdown(spark, sf_dir):
    return search.context_markdown(catalog.edges(spark, sf_dir), catalog.vertices(spark, sf_dir))


@query(f"""{catalog.ctes('vertices', 'edges')}, {ROOTS} SELECT entity_id, 'out' AS direction, type, count(*) AS n FROM edges JOIN roots ON src = entity_id GROUP BY ALL
    UNION ALL SELECT entity_id, 'in', type, count(*) FROM edges JOIN roots ON dst = entity_id GROUP BY ALL""")
def context_edges(spark, sf_dir):
    edges, roots = catalog.edges(spark, sf_dir), graph.listed(_roots(spark, sf_dir))
    out = edges.join(roots, F.col("src") == F.col("entity_id")).select("entity_id", F.lit("out").alias("direction"), "type")
    back = edges.join(roots, F.col("dst") == F.col("entity_id")).select("entity_id", F.lit("in").alias("direction"), "type")
    return out.unionByName(back).groupBy("entity_id", "direction", "type").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS context, count(*) AS members, string_agg(s_name, ', ' ORDER BY s_name) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def moc_by_group(spark, sf_dir):
    s, n = catalog.load(spark, sf_dir, "supplier"), catalog.load(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("context")).agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("s_name")), ", ").alias("names"))


#: Rounds in which DuckDB passes the smallest name on; the graph is less wide than that.
_ROUNDS = 16
_LABELS = ", ".join(
    f"l{i} AS MATERIALIZED (SELECT l.node, least(l.comp, min(n.comp)) AS comp FROM l{i - 1} l JOIN b ON b.src = l.node JOIN l{i - 1} n ON n.node = b.dst GROUP BY l.node, l.comp)" for i in range(1, _ROUNDS)
)


@query(f"""{catalog.ctes('vertices', 'edges')}, b AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    l0 AS MATERIALIZED (SELECT src AS node, least(src, min(dst)) AS comp FROM b GROUP BY src), {_LABELS} SELECT node, comp FROM l{_ROUNDS - 1}""")
def graph_components(spark, sf_dir):
    return graph.components(catalog.edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))
