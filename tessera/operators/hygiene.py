"""Hygiene checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folder_key, language_ok
from ..functions.vectors import similar_pairs
from ..functions.vocab import STRICT_FOLDERS, TUNING
from .usage import since


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def foreign_notes(docs: DataFrame) -> DataFrame:
    """Documents that the language gate refuses."""
    return docs.where(~language_ok(F.col("content")))


def stale_tasks(docs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """agents' open tasks that nobody has touched for days; no status counts as open."""
    own = docs.where("kind = 'task'").where(F.coalesce("status", F.lit("open")) == "open")
    return own.where(~since(F.col("updated_at"), as_of, days)).orderBy("updated_at", "path")


def near_duplicates(vectors: DataFrame, folders: DataFrame, above: float = TUNING.doctor_threshold, skip: list[str] = list(STRICT_FOLDERS)) -> DataFrame:
    """How many pairs of documents outside the template folders are closer than that; vectors (id, vec), folders (id, path)."""
    own = vectors.join(folders.where(~folder_key(F.col("path")).isin(*skip)).select("id"), "id", "left_semi")
    return similar_pairs(own, above).agg(F.count("*").alias("pairs"))
