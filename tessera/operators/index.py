"""Incremental indexing on snapshots (SNK1-SNK7, E3, J12-J14): every function returns the next snapshot of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_id(path: str = "path"):
    """K1: identifiers come from natural keys."""
    return F.sha2(F.concat(F.lit("doc:"), F.col(path)), 256)


def entity_id(kind, name):
    return F.sha2(F.concat(F.lit("entity:"), kind, F.lit(":"), name), 256)


def changed(notes: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Notes (path, content_hash) that are new or differ from what was indexed; before any Python runs."""
    return notes.join(sync_state.select("path", F.col("last_hash").alias("content_hash")), ["path", "content_hash"], "left_anti")


def removed(sync_state: DataFrame, notes: DataFrame) -> DataFrame:
    """Indexed paths that aren't there any more."""
    return sync_state.join(notes.select("path"), "path", "left_anti").select("path")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """SNK1, SNK4, SNK13: old with new's rows in place of those with equal keys; columns in ``keep`` stay as they were."""
    kept = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    fresh = new.join(kept, key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(fresh)


def replace_of(old: DataFrame, new: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """SNK2: all rows of the owners go, new's rows come."""
    return old.join(owners.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def adopt_entities(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """SNK3: the next entities, given notes (document_id, type, name, metadata).

    A note takes over the entity of its document, else a placeholder of its name, else it gets an entity
    of its own (the same one if type and name exist already). Each step is one join.
    """
    own = entities.where("document_id IS NOT NULL").select("document_id", F.col("entity_id").alias("by_doc")).dropDuplicates(["document_id"])
    blank = entities.where("document_id IS NULL").groupBy("name").agg(F.min("entity_id").alias("by_name"))
    same = entities.select("type", "name", F.col("entity_id").alias("by_key"))
    named = notes.join(own, "document_id", "left").join(blank, "name", "left").join(same, ["type", "name"], "left")
    # A placeholder goes to one note of its name: the first by document.
    first = Window.partitionBy("by_name").orderBy("document_id")
    turn = F.when(F.col("by_doc").isNull() & F.col("by_name").isNotNull(), F.row_number().over(first))
    named = named.withColumn("_turn", turn)
    chosen = F.coalesce("by_doc", F.when(F.col("_turn") == 1, F.col("by_name")), "by_key", entity_id(F.col("type"), F.col("name")))
    fresh = named.select(chosen.alias("entity_id"), "type", "name", "document_id", "metadata").dropDuplicates(["entity_id"])
    return entities.join(fresh.select("entity_id"), "entity_id", "left_anti").unionByName(fresh.select(*entities.columns))


def resolve_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links (source_entity_id, relation_type, target) with target_entity_id: an entity of that name, one with a document first; null if none."""
    order = Window.partitionBy("name").orderBy(F.desc(F.col("document_id").isNotNull()), "entity_id")
    best = entities.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("name").alias("target"), F.col("entity_id").alias("target_entity_id"))
    return links.join(best, "target", "left")


def sync_relations(relations: DataFrame, entities: DataFrame, links: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK5, E3: (relations, entities) after the sources' own links are replaced.

    Only edges without an origin document go (the extractor's stay). Names without an entity get a
    placeholder note; edges to itself and repeated edges are dropped.
    """
    found = resolve_links(links, entities)
    missing = found.where("target_entity_id IS NULL").select(F.col("target").alias("name")).distinct()
    placeholders = missing.select(entity_id(F.lit("Note"), F.col("name")).alias("entity_id"), F.lit("Note").alias("type"), "name", F.lit(None).cast("string").alias("document_id"), F.lit('{"placeholder": true}').alias("metadata"))
    target = F.coalesce("target_entity_id", entity_id(F.lit("Note"), F.col("target")))
    edges = found.select("source_entity_id", target.alias("target_entity_id"), "relation_type").where("source_entity_id != target_entity_id").distinct()
    own = sources.select(F.col("entity_id").alias("source_entity_id"), F.lit(True).alias("_own"))
    kept = relations.join(own, "source_entity_id", "left").where("_own IS NULL OR origin_document_id IS NOT NULL").select(*relations.columns)
    key = ["source_entity_id", "target_entity_id", "relation_type"]
    fresh = edges.join(kept.select(*key), key, "left_anti").select(*key, F.lit(1.0).cast("float").alias("confidence"), F.lit(None).cast("string").alias("origin_document_id"))
    return kept.unionByName(fresh.select(*relations.columns)), entities.unionByName(placeholders.select(*entities.columns))


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """SNK6: tables without the documents (document_id): their chunks, entities, and those entities' edges in both directions go too."""
    dead = entities.join(gone, "document_id", "left_semi").select("entity_id")
    edges = relations.join(dead.select(F.col("entity_id").alias("source_entity_id")), "source_entity_id", "left_anti")
    edges = edges.join(dead.select(F.col("entity_id").alias("target_entity_id")), "target_entity_id", "left_anti")
    edges = edges.join(gone.select(F.col("document_id").alias("origin_document_id")), "origin_document_id", "left_anti")
    return {
        "documents": documents.join(gone, "document_id", "left_anti"),
        "chunks": chunks.join(gone, "document_id", "left_anti"),
        "entities": entities.join(gone, "document_id", "left_anti"),
        "relations": edges.select(*relations.columns),
    }


def run_summary(outcomes: DataFrame) -> DataFrame:
    """How many notes were indexed, skipped and failed."""
    return outcomes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "failed")])


def resize_embeddings(chunks: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """SNK17: vectors of another size than the model's are dropped, so that they are made anew."""
    return chunks.withColumn(column, F.when(F.size(column) == dim, F.col(column)))
