"""The engine as one object: tables in, DataFrames out. Methods mirror the service's endpoints and tools."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import authority
from .functions.vectors import Embedder, HashingEmbedder, embed
from .operators import audit, extract, graph, index, lookup, postings, search, usage


@dataclass(frozen=True)
class Knowledge:
    """A snapshot. Queries don't change it; writes return the next one.

    documents (document_id, path, title, content, kind, status, superseded_by, created_at, updated_at, ...),
    chunks (chunk_id, document_id, chunk_index, content, superseded, embedding), entities (entity_id, type,
    name, document_id, kind, summary, origin, sources), relations (src, dst, type, confidence),
    edits (edit_id, path, agent, reason, edit_kind, old_fragment, new_fragment, created_at, reverted_at,
    reverted_by), events (ts, endpoint, method, status, duration_ms, agent).
    """

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    edits: DataFrame | None = None
    events: DataFrame | None = None
    embedder: Embedder = HashingEmbedder()
    index: postings.SearchIndex | None = None

    def embed(self, texts: DataFrame, column: str = "text") -> DataFrame:
        return embed(texts, column, self.embedder)

    def indexed(self, path: str | None = None) -> Knowledge:
        """The same with a search index, written below ``path`` or for this session; searches of one without it write their own."""
        return replace(self, index=postings.search_index(self.chunks, self.documents, path))

    def search(self, queries: DataFrame, limit: int = 8, agent: str | None = None, as_of: str | None = None) -> DataFrame:
        """queries (query_id, q[, vec]) in web syntax: the first documents of each, described, with superseded texts corrected.

        ``agent`` and ``as_of`` mark the caller's own recent notes.
        """
        asked = queries if "vec" in queries.columns else embed(queries, "q", self.embedder, "vec")
        own = self if self.index else self.indexed()
        channels = {
            "text": search.text_channel(own.index, queries),
            "title": search.title_channel(own.index, self.chunks, self.documents, queries),
            "exact": search.exact_channel(own.index, self.chunks, queries),
        }
        if "embedding" in self.chunks.columns:
            channels["vector"] = search.vector_channel(self.chunks.where("embedding IS NOT NULL").select("chunk_id", F.col("embedding").alias("vec")), asked)
        d = self.documents.join(search.document_types(self.entities, self.documents), "document_id", "left")
        column = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
        factors = d.select("document_id", "path", "entity_type", authority(F.col("path"), column("kind"), column("status"), F.col("entity_type"), column("superseded_by")).alias("authority"))
        found = search.rank_documents(search.collapse(search.fuse(channels), self.chunks), factors, limit)
        return search.describe(search.attach_corrections(found, self.chunks), self.chunks, self.documents, agent, as_of)

    def context(self, queries: DataFrame, limit: int = 6) -> DataFrame:
        """Search results with the edges of all their entities as markdown."""
        found = self.search(queries, min(limit, 20))
        lines = search.context_markdown(self.relations, self.entities)
        own = self.entities.where("document_id IS NOT NULL").select("entity_id", "document_id").join(lines, "entity_id")
        each = own.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("entity_id", "markdown"))), lambda m: m["markdown"]).alias("_m"))
        return found.join(each.select("document_id", F.array_join("_m", "\n\n").alias("markdown")), "document_id", "left")

    def note(self, asked: DataFrame) -> DataFrame:
        return lookup.find_note(self.documents, self.entities, asked)

    def entity(self, ids: DataFrame) -> DataFrame:
        return lookup.entity_detail(self.entities, self.documents, self.relations, ids)

    def entity_by_name(self, part: str) -> DataFrame:
        return lookup.entity_list(self.entities, part)

    def graph(self, asked: DataFrame, hops: int = 1, types: list[str] | None = None) -> DataFrame:
        roots = graph.resolve(self.entities, asked)
        return graph.neighbourhood(self.relations, roots, hops, types, cap=200)

    def impact(self, asked: DataFrame) -> dict[str, DataFrame]:
        roots = graph.resolve(self.entities, asked)
        out = {k: graph.related(self.relations, roots, t, inbound) for k, t, inbound in (("belongs_to", "BELONGS_TO", False), ("subscribes", "SUBSCRIBES_TO", False), ("calls_http", "CALLS_HTTP", False), ("called_by_http", "CALLS_HTTP", True))}
        return out | {
            "publishes": graph.publishes(self.relations, roots),
            "attached_knowledge": graph.impact_knowledge(self.relations, self.entities, roots),
            "freshness": graph.freshness(self.entities, self.documents, roots),
        }

    def remember(self, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(note_id, folder, title, kind, content): accepted notes with a path each, and the refused with their problem."""
        judged = audit.valid_notes(notes)
        return audit.free_paths(judged.where("problem IS NULL"), self.documents.select("path")), judged.where("problem IS NOT NULL")

    def proposals(self, include_all: bool = False, limit: int = 30) -> DataFrame:
        return usage.proposals(self.documents, include_all, limit)

    def promote(self, old: str, new: str) -> Knowledge:
        path = F.when(F.col("path") == old, new).otherwise(F.col("path"))
        return replace(self, documents=self.documents.withColumn("path", path), entities=extract.repoint(self.entities, old, new))

    def update_notes(self, edits: DataFrame) -> DataFrame:
        return audit.apply_edits(self.documents.select("path", "content"), edits)

    def undo(self, by: str, as_of: str) -> Knowledge:
        return replace(self, edits=audit.undo(self.edits, by, as_of))

    def history(self, limit: int = 50) -> DataFrame:
        return self.edits.orderBy(F.desc("created_at"), F.desc("edit_id")).limit(limit)

    def changes(self, as_of: str, days: int = 7, limit: int = 30) -> DataFrame:
        return usage.changes(self.documents, as_of, days, limit, tie="path")

    def stats(self, as_of: str, days: int = 30) -> dict[str, DataFrame]:
        own = self.events.where(usage.since(F.col("ts"), as_of, min(max(days, 1), 365)))
        return {"by_endpoint": usage.by_endpoint(own), "by_day": usage.by_day(own), "by_agent": usage.by_agent(own), "totals": usage.totals(own)}

    def link(self, links: DataFrame) -> Knowledge:
        """links (source, target, type, confidence) by names: resolved, then put in place of equal edges (SNK13)."""
        bad = links.select(F.upper("type").alias("type")).where(~F.coalesce(F.col("type").rlike(f"^(?:{graph.SAFE_TYPE.pattern})$"), F.lit(False))).limit(1).collect()
        graph.safe_types([str(r.type) for r in bad])
        names = links.select(F.col("source").alias("q")).unionByName(links.select(F.col("target").alias("q"))).distinct()
        ids = graph.resolve(self.entities, names).select("q", "entity_id")
        both = links.join(ids.select(F.col("q").alias("source"), F.col("entity_id").alias("src")), "source").join(ids.select(F.col("q").alias("target"), F.col("entity_id").alias("dst")), "target")
        new = both.where("src != dst").select("src", "dst", F.upper("type").alias("type"), F.col("confidence").cast("float").alias("confidence")).dropDuplicates(["src", "dst", "type"])
        return replace(self, relations=index.upsert(self.relations.select("src", "dst", "type", "confidence"), new, ["src", "dst", "type"]))
