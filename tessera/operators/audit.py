"""Audited edits, undo, promotion, note writing (SNK8, SNK11, SNK15, W9, P15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import language_ok, slug
from ..functions.vocab import NOTE_KINDS, TUNING


def note_problem(title: str, kind: str) -> str | None:
    """Why a note can't be written; None if it can."""
    if kind not in NOTE_KINDS:
        return f"kind is none of {', '.join(NOTE_KINDS)}"
    if not title.strip():
        return "the title is empty"
    if len(title) > TUNING.title_chars:
        return f"the title has more than {TUNING.title_chars} characters"
    return None


def valid_notes(notes: DataFrame) -> DataFrame:
    """P14, P15 on a batch: notes (title, kind, content) with ``problem`` (null if none)."""
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(*NOTE_KINDS), F.lit(False)), "kind")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "empty title")
        .when(F.length("title") > TUNING.title_chars, "long title")
        .when(~language_ok(F.coalesce("content", F.lit(""))), "language")
    )
    return notes.withColumn("problem", problem)


def free_paths(notes: DataFrame, taken: DataFrame) -> DataFrame:
    """Notes (note_id, folder, title) with a path of their own: slug.md, or else slug-2.md, slug-3.md, ...: the first that is free.

    Not free is what is in taken (path), and the plain slug of another note of the batch: it goes to the
    first note by id that has it. So all paths differ, and a batch needs no round trip for each note.
    """
    base = notes.withColumn("_stem", F.concat("folder", F.lit("/"), slug(F.col("title"))))
    had = taken.select(F.regexp_replace("path", r"\.md$", "").alias("_whole"))
    numbered = had.unionByName(base.select(F.col("_stem").alias("_whole")))
    cut = r"^(.*)-([1-9][0-9]{0,8})$"
    numbered = numbered.select(F.regexp_extract("_whole", cut, 1).alias("_stem"), F.nullif(F.regexp_extract("_whole", cut, 2), F.lit("")).cast("int").alias("n")).where("n >= 2")
    used = numbered.unionByName(had.select(F.col("_whole").alias("_stem"), F.lit(1).alias("n")))
    used = used.join(base.select("_stem").distinct(), "_stem", "left_semi").groupBy("_stem").agg(F.sort_array(F.collect_set("n")).alias("_used"))
    turn = F.row_number().over(Window.partitionBy("_stem").orderBy("note_id"))
    # The i-th free number: a used one is passed if fewer than i free ones stand before it.
    passed = "size(filter(transform(coalesce(_used, array()), (u, j) -> u - 1 - j), x -> x < _t))"
    out = base.join(used, "_stem", "left").withColumn("_t", turn).withColumn("_t", F.expr(f"_t + {passed}"))
    return out.withColumn("path", F.concat("_stem", F.when(F.col("_t") > 1, F.concat(F.lit("-"), F.col("_t").cast("string"))).otherwise(""), F.lit(".md"))).drop("_stem", "_used", "_t")


def provenance_note(title: str, body: str, agent: str, kind: str, tags: list[str], created: str) -> str:
    """SNK8: the file of an agent's note."""
    lines = ["---", f'title: "{title}"', f"kind: {kind}", f'source: "agent:{agent}"', f'created_by: "{agent}"', f"created: {created}"]
    tags = list(dict.fromkeys(tags))
    return "\n".join([*lines, *(["tags:", *(f"  - {t}" for t in tags)] if tags else []), "---", "", f"# {title}", "", body.strip(), ""])


def apply_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Replacements (edits: path, old_fragment, new_fragment, one for each path) where the fragment stands exactly once, overlaps counted.

    Returns path, content, outcome (edited, missing, ambiguous, untouched). The text is taken literally.
    """
    both = notes.join(edits, "path", "left")
    at = F.expr("locate(old_fragment, content)")
    again = F.expr("locate(old_fragment, content, locate(old_fragment, content) + 1)")
    outcome = F.when(F.col("old_fragment").isNull(), "untouched").when(at == 0, "missing").when(again > 0, "ambiguous").otherwise("edited")
    new = F.expr("concat(substring(content, 1, locate(old_fragment, content) - 1), new_fragment, substring(content, locate(old_fragment, content) + char_length(old_fragment)))")
    return both.withColumn("outcome", outcome).select("path", F.when(F.col("outcome") == "edited", new).otherwise(F.col("content")).alias("content"), "outcome")


def undo(edits: DataFrame, by: str, as_of: str) -> DataFrame:
    """SNK15, K23, K24: the log with the newest open edit of each path marked as reverted; promotions can't be undone."""
    newest = Window.partitionBy("path").orderBy(F.desc("created_at"), F.desc("edit_id"))
    open_ = edits.where("reverted_at IS NULL").withColumn("_n", F.row_number().over(newest)).where("_n = 1 AND edit_kind != 'promote'").select("edit_id", F.lit(True).alias("_hit"))
    marked = edits.join(open_, "edit_id", "left")
    return marked.select(*[
        F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("reverted_at")).alias(c) if c == "reverted_at" else F.when(F.col("_hit"), F.lit(by)).otherwise(F.col("reverted_by")).alias(c) if c == "reverted_by" else F.col(c)
        for c in edits.columns
    ])


