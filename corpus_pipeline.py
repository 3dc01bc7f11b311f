"""A corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.

Stages decide by row: rows that share an identifier, or have none, are told apart by their text. Null texts
count as empty (and go at the first stage, as they have no letter), extra columns pass through, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table, text_key, without
from tessera.llm.decontaminate import leaks
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language import fit, identify
from tessera.llm.ngram_join import ngram_groups
from tessera.llm.packing import pack_documents

#: A best language with less of the weight than this is no answer.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language has less than half of the weight."""
    found = identify(text_key(docs), fit(docs, F.lit(True)))
    return without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("doc_id.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, one with the smallest doc_id stays (null before all others)."""
    found = stage(exact_dedup(text_key(docs)).select("doc_id.*", "kept", "group_size"), "copies")
    copies, kept = found.where("not kept"), found.where("kept AND group_size > 1")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "text_hash")]
    keys = copies.distinct().alias("l")
    # A copy that repeats the row that stays, identifier and text, can't be named apart from it: of those rows one stays.
    repeated = keys.join(kept.alias("r"), same[0] & same[1], "left_semi")
    return without(docs, keys.join(kept.alias("r"), same[0] & same[1], "left_anti"), once=repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 5-word Jaccard links of 0.8 or more, one with the smallest doc_id stays (null after all others)."""
    found = stage(ngram_groups(docs, n=5, percent=80).where("comp IS NOT NULL").select("doc_id", "text_hash", "comp"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    groups = stage(found.groupBy("comp").agg(first, F.count("*").alias("n")).where("n > 1").select("comp", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "firsts")
    rows = found.join(groups, "comp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    repeated = rows.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1")
    return without(docs, rows.where("not stays"), once=repeated)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, be it with other numbers or names."""
    return without(docs, leaks(docs, table(spark, sf_dir, "benchmark"), by_text=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, capacity=4096, end_id=1)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: The stages' decisions come from a trained model, an iterated join and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
