"""Storing what was extracted: edges, entities, provenance, state and the sweep in one commit (SNK12, E5, E5b, E6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key
from ..sources.io import stage
from ..sources.tables import Tables
from .extract import match_entities, orphans, origin
from .index import entity_id

ENTITIES = "entity_id string, type string, name string, document_id string, kind string, summary string, confidence double, sources array<string>, origin string"
RELATIONS = "source_entity_id string, target_entity_id string, relation_type string, confidence double, origin_document_id string"
STATE = "document_id string, last_hash string, model string, extracted_at string"
EDGE = ["source_entity_id", "target_entity_id", "relation_type"]


def suffixes(key):
    """All suffixes of a name's key that begin after a dash, and the key itself."""
    parts = F.split(key, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))


def name_new(objects: DataFrame) -> DataFrame:
    """objects without an entity (name, type, seq): name, entity_id of the new entity that each name means.

    Names with one key are one entity, and so are names of which one ends in a dash and the other: the
    shortest such new key stands for all of them. The entity is named after the first object of it.
    """
    keys = objects.select("name", "type", "seq", entity_key(F.col("name")).alias("key"))
    known = keys.select("key").distinct()
    ends = known.select("key", F.explode(suffixes(F.col("key"))).alias("end")).join(known.select(F.col("key").alias("end")), "end")
    root = ends.groupBy("key").agg(F.min_by("end", F.length("end")).alias("root"))
    rooted = keys.join(root, "key")
    first = rooted.groupBy("root").agg(F.min_by(F.struct("type", "name"), "seq").alias("f"))
    named = rooted.join(first.select("root", F.col("f.name").alias("first_name"), entity_id(F.col("f.type"), F.col("f.name")).alias("entity_id")), "root")
    return named.select("name", "entity_id", "first_name").distinct()


def stored(docs: DataFrame, extraction: DataFrame, entities: DataFrame, relations: DataFrame, state: DataFrame, model: str, as_of: str) -> dict[str, DataFrame]:
    """The next entities, relations and extraction_state after a batch of extractions (E5, SNK12, SNK14).

    docs (document_id, path, title, content_hash); extraction (document_id, objects, relations) as ``extract`` gives it, one row a document.
    Documents count in the order of their paths, objects and relations in theirs.

    Edges that came from these documents go. An object means an entity of its name (``match_entities``): one with a document is left
    as it is, another takes type, summary and confidence of the last object that means it and all their paths as sources; names
    without an entity get one. Objects point at their document's own entity (EXTRACTED_FROM), relations join names of one document, its title
    included; loops, unknown names and edges that exist are passed over, and of equal new edges the first stays. Semantic entities without
    a document and without an edge then go. Objects without a name or type, and documents without an extraction, add nothing.
    """
    d = docs.select(F.col("document_id").cast("string").alias("document_id"), "path", "title", "content_hash").dropDuplicates(["document_id"])
    got = extraction.select(F.col("document_id").cast("string").alias("document_id"), "objects", F.col("relations").alias("links")).dropDuplicates(["document_id"]).join(d, "document_id")
    place = lambda at: F.struct("path", "document_id", at)
    o = got.select("document_id", "path", F.posexplode("objects").alias("at", "o"))
    o = o.select("document_id", "path", place("at").alias("seq"), "o.name", "o.type", "o.summary", "o.confidence").where("name IS NOT NULL AND type IS NOT NULL")
    matched = stage(match_entities(o, entities), "matched")
    fresh = stage(name_new(matched.where("entity_id IS NULL")), "new_names")
    known = matched.join(fresh.withColumnRenamed("entity_id", "new_id"), "name", "left")
    known = stage(known.select("document_id", "path", "seq", "name", "type", "summary", "confidence", F.coalesce("entity_id", "new_id").alias("entity_id"), F.coalesce("doc", F.lit(False)).alias("doc"), "first_name"), "objects")

    said = known.where("NOT doc").groupBy("entity_id").agg(
        F.max_by(F.struct("type", "summary", "confidence"), "seq").alias("last"), F.array_sort(F.collect_set("path")).alias("paths"), F.min("first_name").alias("first_name"))
    none = F.array().cast("array<string>")
    # A left join from the batch, so the whole table of entities is only passed over.
    old = entities.select("entity_id", F.col("name").alias("old_name"), F.col("sources").alias("old"))
    told = said.join(old, "entity_id", "left").select(
        "entity_id", "last.type", F.coalesce("old_name", "first_name").alias("name"), F.lit(None).cast("string").alias("document_id"), F.lit("semantic").alias("kind"), "last.summary", "last.confidence",
        F.array_union(F.coalesce("old", none), "paths").alias("sources")).withColumn("origin", origin(F.col("sources")))
    columns = entities.columns
    every = stage(entities.join(told.select("entity_id"), "entity_id", "left_anti").select(*columns).unionByName(told.select(*columns)), "entities")

    own = every.where("document_id IS NOT NULL").groupBy("document_id").agg(F.min("entity_id").alias("note"))
    proof = known.join(own, "document_id").select(F.col("entity_id").alias("source_entity_id"), F.col("note").alias("target_entity_id"), F.lit("EXTRACTED_FROM").alias("relation_type"), "confidence", "document_id", "path", F.lit(0).alias("part"), F.col("seq.at").alias("at"))
    names = known.select("document_id", F.lower("name").alias("n"), "entity_id", F.col("seq.at").alias("at"))
    names = names.unionByName(d.join(own, "document_id").select("document_id", F.lower("title").alias("n"), F.col("note").alias("entity_id"), F.lit(-1).alias("at")))
    names = names.groupBy("document_id", "n").agg(F.max_by("entity_id", "at").alias("entity_id"))
    links = got.select("document_id", "path", F.posexplode("links").alias("at", "r")).select("document_id", "path", "at", F.lower("r.source").alias("s"), F.lower("r.target").alias("t"), F.col("r.type").alias("relation_type"), "r.confidence")
    end = lambda key, name: names.select("document_id", F.col("n").alias(key), F.col("entity_id").alias(name))
    meant = links.join(end("s", "source_entity_id"), ["document_id", "s"]).join(end("t", "target_entity_id"), ["document_id", "t"])
    edges = proof.unionByName(meant.select(*EDGE, "confidence", "document_id", "path", F.lit(1).alias("part"), "at")).where("source_entity_id != target_entity_id")
    first = edges.groupBy(*EDGE).agg(F.min_by(F.struct("confidence", "document_id"), F.struct("path", "document_id", "part", "at")).alias("f"))
    kept = relations.join(got.select(F.col("document_id").alias("origin_document_id")), "origin_document_id", "left_anti").select(*relations.columns)
    added = first.select(*EDGE, F.col("f.confidence").cast("double").alias("confidence"), F.col("f.document_id").alias("origin_document_id")).join(kept.select(*EDGE), EDGE, "left_anti")
    edges = stage(kept.unionByName(added.select(*relations.columns)), "relations")

    lost = orphans(every, edges).select("entity_id")
    done = got.select("document_id", F.col("content_hash").alias("last_hash"), F.lit(model).alias("model"), F.lit(as_of).alias("extracted_at"))
    return {
        "entities": every.join(lost, "entity_id", "left_anti").select(*columns),
        "relations": edges,
        "extraction_state": state.join(done.select("document_id"), "document_id", "left_anti").select(*done.columns).unionByName(done),
    }


def store_extraction(tables: Tables, docs: DataFrame, extraction: DataFrame, model: str, as_of: str) -> int:
    """SNK12: ``stored`` on the newest commit's tables, written as the next commit; on a failure midway the tables stay as they were."""
    base = tables.version()
    now = {name: tables.read(name, base) for name in ("entities", "relations", "extraction_state")}
    return tables.commit(stored(docs, extraction, now["entities"], now["relations"], now["extraction_state"], model, as_of), base)
