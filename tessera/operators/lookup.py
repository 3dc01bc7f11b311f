"""Single notes and entities, golden checks, and what is written out for people (SRC9, SRC12-SRC14, E8, SNK9, W10)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from .contain import clean, contained, gram_index
from .graph import few


def find_note(documents: DataFrame, entities: DataFrame, asked: DataFrame) -> DataFrame:
    """SRC12: for each asked (q) one document: equal path, path with q in it, equal title, title with q in it, then by its entity's name.

    Case doesn't matter and wildcards are taken literally; ties go by the shorter path, then the path.
    """
    q = few(asked.select("q", clean(F.lower("q")).alias("needle")).where("q != ''").distinct())
    said = {"path": documents.select("document_id", F.col("path").alias("text")), "title": documents.select("document_id", F.col("title").alias("text")), "name": entities.where("document_id IS NOT NULL").select("document_id", F.col("name").alias("text"))}
    texts = functools.reduce(DataFrame.unionByName, [t.select("document_id", F.lit(f).alias("field"), clean(F.lower("text")).alias("text")) for f, t in said.items()])
    fields = F.explode(F.array(*[F.lit(f) for f in said])).alias("field")
    hit = contained(gram_index(texts.select("field", "text")), q.select("needle", fields)).join(texts, ["field", "text"]).join(q, "needle").join(documents.select("document_id", "path"), "document_id")
    same = F.col("text") == F.col("needle")
    order = F.when(F.col("field") == "path", F.when(same, 1).otherwise(2)).when(F.col("field") == "title", F.when(same, 3).otherwise(4)).otherwise(5)
    first = Window.partitionBy("q").orderBy(order, F.length("path"), "path")
    return hit.withColumn("how", order).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("q", "document_id", "path", "how")


def entity_list(entities: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """SRC14: entities with ``part`` in the name, by name."""
    return entities.where(contains_ci(F.col("name"), F.lit(part))).orderBy("name", "entity_id").limit(limit)


def entity_detail(entities: DataFrame, documents: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """SRC13, J3, J5: the asked entities with their documents' paths and their edges in both directions (one row for each edge, one without edges)."""
    own = entities.join(few(ids.select("entity_id")), "entity_id", "left_semi").join(documents.select("document_id", "path"), "document_id", "left")
    names = entities.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name"))
    out = edges.select(F.col("src").alias("entity_id"), F.lit("out").alias("direction"), F.col("type").alias("relation"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("entity_id"), F.lit("in").alias("direction"), F.col("type").alias("relation"), F.col("src").alias("other"))
    near = out.unionByName(back).join(own.select("entity_id"), "entity_id", "left_semi").join(names, "other", "left")
    return own.select("entity_id", "type", "name", "path").join(near, "entity_id", "left")


def golden_results(checks: DataFrame, results: DataFrame, top: int = 5) -> DataFrame:
    """SRC9: for each search check (query_id, expect_path, top_n) whether a result (query_id, path, position) among the first has the expected path in it."""
    hit = checks.join(results, "query_id", "left").withColumn("ok", (F.col("position") <= F.coalesce("top_n", F.lit(top))) & F.contains("path", F.col("expect_path")))
    return hit.groupBy("query_id").agg(F.coalesce(F.max("ok"), F.lit(False)).alias("passed"), F.count("path").alias("results"), F.countDistinct("path").alias("documents"))


def map_of_content(members: DataFrame, group: str, name: str) -> DataFrame:
    """SNK9, W10: one markdown text for each group: a heading and the sorted links to its members."""
    links = F.transform(F.sort_array(F.collect_list(name)), lambda n: F.concat(F.lit("- [["), n, F.lit("]]")))
    return members.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n"), F.array_join(links, "\n")).alias("markdown"))


def impact_markdown(report: dict) -> str | None:
    """An impact report (one entity, on the driver) as a comment; None if it says nothing.

    report: name, type, belongs_to, publishes ({topic: consumers}), subscribes, calls_http, called_by_http,
    knowledge ([(type, name, summary, source)]).
    """
    parts = []
    for topic, consumers in sorted(report.get("publishes", {}).items()):
        parts.append(f"- publishes to **{topic}**" + (f", read by {', '.join(sorted(consumers))}" if consumers else ", read by nobody known"))
    for key, words in (("subscribes", "reads"), ("calls_http", "calls"), ("called_by_http", "is called by")):
        if report.get(key):
            parts.append(f"- {words} {', '.join(sorted(report[key]))}")
    known = [f"- {kind} **{name}** ({source})" + (f": {summary}" if summary else "") for kind, name, summary, source in report.get("knowledge", [])]
    if not parts and not known:
        return None
    head = f"### Impact of {report['name']} ({report['type']})"
    where = [f"Part of {', '.join(sorted(report['belongs_to']))}."] if report.get("belongs_to") else []
    return "\n".join([head, *where, *parts, *(["#### What is known", *known] if known else [])])
