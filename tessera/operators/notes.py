"""Notes: parsing and chunking."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WIKILINK
from ..functions.vocab import CORRECTION_WORDS, FOLDER_TYPES, FRONTMATTER_TYPES, RELATION_KEYS, TUNING
from ..sources.io import ship

CORRECTION = r"(?i)^#{1,6}\s.*\b(?:" + "|".join(CORRECTION_WORDS) + r")\b"
CHUNKS = "array<struct<content:string,superseded:boolean>>"


def heading_title(body: Column) -> Column:
    """The first level-one heading's text; null without one."""
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def note_type(path: Column, declared: Column) -> Column:
    """The declared type if it is known, else that of the first folder that stands for one, else Note."""
    named = F.concat(F.upper(F.substring(declared, 1, 1)), F.lower(F.substring(declared, 2, 1 << 20)))
    folders = F.create_map(*[F.lit(x) for pair in FOLDER_TYPES.items() for x in pair])
    by_folder = F.get(F.filter(F.transform(F.split(F.lower(path), "/"), lambda s: F.try_element_at(folders, s)), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(F.when(named.isin(*FRONTMATTER_TYPES), named), by_folder, F.lit("Note"))


def strip_link(value: Column) -> Column:
    return F.trim(F.when(value.rlike(r"^\[\[[^\]|#]+"), F.regexp_extract(value, "^" + WIKILINK, 1)).otherwise(value))


def as_strings(json: Column, key: str) -> Column:
    """A frontmatter entry as strings: a list as it is, a scalar as a list of one, nothing as an empty list."""
    raw = F.get_json_object(json, f"$.{key}")
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(listed, F.array(raw))).otherwise(F.array(raw))


def _as(kind: str):
    return lambda target: F.struct(F.lit(kind).alias("type"), target.alias("target"))


def links_of(body: Column, frontmatter: Column, title: Column) -> Column:
    """E1d-E1f: distinct (type, target) in order: wiki links as MENTIONS (never to itself), then the frontmatter's typed ones."""
    wiki = F.filter(F.transform(F.regexp_extract_all(body, F.lit(WIKILINK + r"[^\]]*\]\]"), F.lit(1)), lambda t: F.trim(t)), lambda t: (t != "") & (t != title))
    found = [F.transform(wiki, _as("MENTIONS"))]
    for key in RELATION_KEYS:
        typed = F.filter(F.transform(as_strings(frontmatter, key), strip_link), lambda t: t != "")
        found.append(F.transform(typed, _as(key.upper())))
    return F.array_distinct(F.concat(*found))


def parse_notes(notes: DataFrame) -> DataFrame:
    """Notes (path, raw, body, frontmatter) with title, type, tags, links and content_hash."""
    fm = F.col("frontmatter")
    title = F.coalesce(F.nullif(F.get_json_object(fm, "$.title"), F.lit("")), heading_title(F.col("body")), basename(F.col("path")))
    titled = notes.withColumn("title", title)
    return titled.withColumns(
        {
            "type": note_type(F.col("path"), F.get_json_object(fm, "$.type")),
            "tags": as_strings(fm, "tags"),
            "links": links_of(F.col("body"), fm, F.col("title")),
            "content_hash": F.sha2("raw", 256),
        }
    )


def sections(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, section, content, superseded) by headings; a section is superseded by a later correction."""
    parts = F.filter(F.transform(F.split(F.col(body), r"\n(?=#{1,6}\s)"), lambda s: F.trim(s)), lambda s: s != "")
    each = df.select(key, F.posexplode(parts).alias("section", "content"))
    fixes = F.regexp_extract("content", r"^([^\n]*)", 1).rlike(CORRECTION)
    later = Window.partitionBy(key).orderBy("section").rowsBetween(1, Window.unboundedFollowing)
    return each.withColumn("superseded", F.coalesce(F.max(fixes).over(later), F.lit(False)))


def hard_split(text: str, most: int = TUNING.chunk_chars, soft: float = TUNING.soft_cut) -> list[str]:
    """E2d: pieces of ``most`` characters at most, cut at the last space where that leaves 60 % or more."""
    out, at = [], 0
    while len(text) - at > most:
        space = text.rfind(" ", at, at + most + 1) - at
        cut = space if space >= most * soft else most
        out.append(text[at : at + cut].strip())
        at += cut
    return [p for p in [*out, text[at:].strip()] if p]


def chunk_text(body: str, most: int = TUNING.chunk_chars) -> list[tuple[str, bool]]:
    """(content, superseded) in order: by headings, then whole paragraphs as far as they fit, long paragraphs split."""
    out: list[list] = []
    for section in re.split(r"\n(?=#{1,6}\s)", body or ""):
        section = section.strip()
        if not section:
            continue
        if re.search(CORRECTION, section.split("\n", 1)[0]):
            for earlier in out:
                earlier[1] = True
        pieces: list[str] = []
        if len(section) <= most:
            pieces = [section]
        else:
            held = ""
            for paragraph in re.split(r"\n{2,}", section):
                long = len(paragraph) > most
                if held and (long or len(held) + len(paragraph) + 2 > most):
                    pieces.append(held.strip())
                    held = ""
                if long:
                    pieces += hard_split(paragraph, most)
                else:
                    held = f"{held}\n\n{paragraph}" if held else paragraph
            pieces.append(held.strip())
        out += [[p, False] for p in pieces if p]
    return [(c, s) for c, s in out]


def chunk_documents(docs: DataFrame, key: str = "document_id", body: str = "body") -> DataFrame:
    """(key, chunk_index, content, superseded); texts go to Python in Arrow batches, since packing is sequential."""
    ship(docs.sparkSession)

    @F.arrow_udf(CHUNKS)
    def cut(column: pa.Array) -> pa.Array:
        rows = [[{"content": c, "superseded": s} for c, s in chunk_text(t or "")] for t in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("content", pa.string()), ("superseded", pa.bool_())])))

    return docs.select(key, F.posexplode(cut(body)).alias("chunk_index", "c")).select(key, "chunk_index", "c.content", "c.superseded")
