"""Knowledge extraction: selection, storage, origins, orphans (E4-E6, SNK12-SNK14)."""

from __future__ import annotations

import json
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ci, entity_key
from ..functions.vocab import EXTRACTED_RELATIONS, EXTRACTED_TYPES, TUNING
from ..sources.io import ship

EXTRACTION = "objects array<struct<type:string,name:string,summary:string,confidence:double>>, relations array<struct<source:string,target:string,type:string,confidence:double>>"


def pending(documents: DataFrame, state: DataFrame, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents never extracted, or changed since; in order of path."""
    known = state.select("document_id", "last_hash")
    todo = documents.join(known, "document_id", "left").where("last_hash IS NULL OR last_hash != content_hash").drop("last_hash")
    if path:
        todo = todo.where(contains_ci(F.col("path"), F.lit(path)))
    return todo.orderBy("path").limit(limit) if limit else todo


def prompt(content: Column, most: int = TUNING.prompt_chars) -> Column:
    """What the extractor is given: long content is cut, and says so."""
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("\n[cut]"))).otherwise(content)


class Extractor(Protocol):
    """SRC7: a document's text to the model's answer, which holds a JSON object somewhere."""

    def __call__(self, text: str) -> str: ...


def extract(docs: DataFrame, extractor: Extractor, attempts: int = 2) -> DataFrame:
    """(document_id, objects, relations) of docs (document_id, content); answers that don't fit the schema are tried again, then left out."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, answers = [], []
            for i, text in zip(batch.column("document_id").to_pylist(), batch.column("content").to_pylist()):
                for _ in range(attempts):
                    got = extractor(text or "")
                    body = got[got.find("{") : got.rfind("}") + 1] if "{" in got else ""
                    try:
                        json.loads(body)
                    except ValueError:
                        continue
                    ids.append(str(i))
                    answers.append(body)
                    break
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(answers, pa.string())], names=["document_id", "answer"])

    raw = docs.select(F.col("document_id").cast("string").alias("document_id"), prompt(F.col("content")).alias("content")).mapInArrow(run, "document_id string, answer string")
    parsed = raw.withColumn("x", F.from_json("answer", EXTRACTION)).select("document_id", "x.objects", "x.relations")
    good = F.forall("objects", lambda o: o["type"].isin(*EXTRACTED_TYPES) & F.length(o["name"]).between(1, 120) & (F.length(o["summary"]) > 0) & o["confidence"].between(0, 1))
    fine = F.forall("relations", lambda r: r["type"].isin(*EXTRACTED_RELATIONS) & (r["source"] != "") & (r["target"] != "") & r["confidence"].between(0, 1))
    return parsed.where(F.coalesce(good & fine & (F.size("objects") <= 60), F.lit(False)))


def origin(sources: Column) -> Column:
    """Agent if every source is an agent's note, else human."""
    return F.when(F.forall(sources, lambda s: s.startswith("agents/")), "agent").otherwise("human")


def match_entities(objects: DataFrame, entities: DataFrame) -> DataFrame:
    """Objects (name, type, ...) with the entity each one means, or null.

    Names are equal, or one ends in a dash and the other. Both directions are equi-joins on the dash
    suffixes of the longer name, so no pair of all names is formed. A document's entity comes first, then
    equal names, then the same type, then the id.
    """
    def suffixes(key: str) -> Column:
        parts = F.split(key, "-")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))

    o = objects.select("name", "type").distinct().withColumn("ok", entity_key(F.col("name")))
    e = entities.select("entity_id", F.col("type").alias("etype"), entity_key(F.col("name")).alias("ek"), F.col("document_id").isNotNull().alias("doc"))
    longer = e.withColumn("join", F.explode(suffixes("ek"))).join(o.withColumn("join", F.col("ok")), "join")
    shorter = o.withColumn("join", F.explode(suffixes("ok"))).join(e.withColumn("join", F.col("ek")), "join")
    cols = ["name", "type", "ok", "entity_id", "etype", "ek", "doc"]
    both = longer.select(*cols).unionByName(shorter.select(*cols)).distinct()
    order = Window.partitionBy("name", "type").orderBy(F.desc("doc"), F.desc(F.col("ek") == F.col("ok")), F.desc(F.col("etype") == F.col("type")), "entity_id")
    best = both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("name", "type", "entity_id", "doc")
    return objects.join(best, ["name", "type"], "left")


def merge_sources(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """E5: entities (entity_id, sources) with the paths of mentions (entity_id, path) added once, and the origin anew."""
    fresh = mentions.groupBy("entity_id").agg(F.sort_array(F.collect_set("path")).alias("_new"))
    merged = entities.join(fresh, "entity_id", "left").withColumn("sources", F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))))
    return merged.withColumn("origin", origin(F.col("sources"))).drop("_new")


def provenance_edges(objects: DataFrame, notes: DataFrame) -> DataFrame:
    """SNK12: EXTRACTED_FROM edges from objects (document_id, entity_id, confidence) to their notes (document_id, note_entity_id); none to itself."""
    hit = objects.join(notes, "document_id").where("entity_id != note_entity_id")
    best = hit.groupBy(F.col("entity_id").alias("source_entity_id"), F.col("note_entity_id").alias("target_entity_id")).agg(F.max("confidence").alias("confidence"), F.min("document_id").alias("origin_document_id"))
    return best.withColumn("relation_type", F.lit("EXTRACTED_FROM"))


def semantic_edges(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations (document_id, source, target, type) between names (document_id, name, entity_id) of the same document; others are dropped."""
    low = names.select("document_id", F.lower("name").alias("n"), "entity_id")
    src, dst = low.select("document_id", F.col("n").alias("s"), F.col("entity_id").alias("source_entity_id")), low.select("document_id", F.col("n").alias("t"), F.col("entity_id").alias("target_entity_id"))
    keyed = relations.withColumns({"s": F.lower("source"), "t": F.lower("target")})
    both = keyed.join(src, ["document_id", "s"]).join(dst, ["document_id", "t"]).where("source_entity_id != target_entity_id")
    return both.select("source_entity_id", "target_entity_id", F.col("type").alias("relation_type")).distinct()


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Semantic entities without a document and without an edge on either side."""
    ends = relations.select(F.col("source_entity_id").alias("entity_id")).unionByName(relations.select(F.col("target_entity_id").alias("entity_id"))).distinct()
    return entities.where("kind = 'semantic' AND document_id IS NULL").join(ends, "entity_id", "left_anti")


def repoint(entities: DataFrame, old: str, new: str) -> DataFrame:
    """SNK14, A8, P9: entities (sources) with a path moved, and the origin of those anew."""
    has = F.array_contains("sources", old)
    moved = F.when(has, F.transform("sources", lambda s: F.when(s == old, new).otherwise(s))).otherwise(F.col("sources"))
    out = entities.withColumn("_moved", has).withColumn("sources", moved)
    return out.withColumn("origin", F.when(F.array_contains("sources", new), origin(F.col("sources"))).otherwise(F.col("origin"))).drop("_moved")
