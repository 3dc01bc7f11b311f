"""Near-duplicate report over document centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folder_key
from ..functions.vectors import centroids, similar_pairs
from ..functions.vocab import STRICT_FOLDERS, TUNING
from ..sources.io import stage
from .graph import components


def pair_threshold(folder_a: Column, folder_b: Column, base: float = TUNING.dedup_base, include_all: bool = False, strict: dict[str, float] = STRICT_FOLDERS) -> Column:
    """The largest of the base and what the two folders ask for."""
    if include_all or not strict:
        return F.lit(base)
    table = F.create_map(*[F.lit(x) for pair in strict.items() for x in pair])
    own = lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0.0))
    return F.greatest(F.lit(base), own(folder_a), own(folder_b))


def document_vectors(chunks: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """A5: id, vec: the mean of each document's chunk vectors."""
    return centroids(chunks, key, vector, dims).select(F.col(key).cast("long").alias("id"), F.col("centroid").alias("vec"))


def report_pairs(vectors: DataFrame, folders: DataFrame, base: float = TUNING.dedup_base, include_all: bool = False, strict: dict[str, float] = STRICT_FOLDERS) -> DataFrame:
    """Pairs (a, b, sim) above the base, and whether they are kept by their folders' threshold; folders (id, path)."""
    found = similar_pairs(vectors, base)
    f = folders.select("id", folder_key(F.col("path")).alias("f"))
    both = found.join(f.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a").join(f.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
    return both.withColumn("kept", F.col("sim") > pair_threshold(F.col("fa"), F.col("fb"), base, include_all, strict))


def suppressed(pairs: DataFrame) -> DataFrame:
    """How many pairs there are, and how many the folders' thresholds hide."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(~F.col("kept")).alias("suppressed"))


def clusters(pairs: DataFrame, updated: DataFrame, write=stage) -> DataFrame:
    """Members of each cluster: cluster, id, canonical, label ("canon", the similarity to the canonical, or "trans").

    The canonical member is the newest (updated: id, updated_at; ties by the smallest id).
    """
    kept = write(pairs.where("kept").select("a", "b", "sim"))
    comp = components(kept, write).withColumnRenamed("node", "id")
    newest = Window.partitionBy("comp").orderBy(F.desc("updated_at"), "id")
    member = comp.join(updated, "id").withColumn("canonical", F.first("id").over(newest))
    direct = kept.select(F.col("a").alias("id"), F.col("b").alias("canonical"), "sim").unionByName(kept.select(F.col("b").alias("id"), F.col("a").alias("canonical"), "sim"))
    label = F.when(F.col("id") == F.col("canonical"), "canon").when(F.col("sim").isNotNull(), F.format_number("sim", 3)).otherwise("trans")
    return member.join(direct, ["id", "canonical"], "left").select(F.col("comp").alias("cluster"), "id", "canonical", label.alias("label"))


def ordered_clusters(members: DataFrame, documents: DataFrame) -> DataFrame:
    """Cluster, folders, size of each cluster of members (cluster, id), in the report's order: by the folders, the largest first.

    folders: the distinct folder keys (N1) of the members' paths (documents: id, path), sorted, with " ↔ " in between.
    """
    own = members.join(documents.select("id", folder_key(F.col("path")).alias("folder")), "id")
    folders = F.array_join(F.sort_array(F.collect_set("folder")), " ↔ ").alias("folders")
    return own.groupBy("cluster").agg(folders, F.count("*").alias("size")).orderBy("folders", F.desc("size"), "cluster")


def suffix_suspects(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths that end in a dash and a number, and the path without that, where it exists."""
    copy = paths.where(F.col(column).rlike(r"-[0-9]+\.md$")).select(F.col(column).alias("copy"), F.regexp_replace(column, r"-[0-9]+\.md$", ".md").alias("original"))
    return copy.join(paths.select(F.col(column).alias("original")).distinct(), "original")
