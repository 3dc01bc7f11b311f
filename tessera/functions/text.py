"""Text expressions (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import TUNING

# Repeated groups are possessive: Java matches others by recursion, which a text of thousands of joined parts overflows.
#: Patterns of search terms, rare tokens and references.
TERM = r"[\p{L}\p{N}]++(?:[._'-][\p{L}\p{N}]++)*+"
NUMBER_TOKEN = r"\d++(?:[.,]\d++)?+%?"
IDENTIFIER_TOKEN = r"[A-Za-z][A-Za-z0-9]*+(?:[-_./][A-Za-z0-9]++)++"
ANALYSIS_COMMIT = r"analysis-commit:\s*([0-9a-f]{6,40})"
WIKILINK = r"\[\[([^\]|#]+)"
PR_URL = r"(?i)https?://github\.com/[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+?)(?:\.git)?/pull/\d+"


def terms(text: Column) -> Column:
    """Search terms, in order, with repeats. ``/`` separates; dotted and dashed terms stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def normalise_separators(text: Column) -> Column:
    """Lower case; runs of dashes, underscores, dots, slashes and white space become one space."""
    return F.regexp_replace(F.lower(text), r"[-_./\s]+", " ")


def rare_tokens(text: Column, most: int = TUNING.rare_tokens) -> Column:
    """Numbers (with % or of 3 characters or more), then joined identifiers of 4 or more; distinct, in order, six at most."""
    numbers = F.filter(F.regexp_extract_all(text, F.lit(f"({NUMBER_TOKEN})"), F.lit(1)), lambda t: t.contains("%") | (F.length(t) >= 3))
    names = F.filter(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER_TOKEN})"), F.lit(1)), lambda t: F.length(t) >= 4)
    return F.slice(F.array_distinct(F.concat(numbers, names)), 1, most)


def slug(text: Column) -> Column:
    """SNK8: lower case, other runs as one dash, no dash at the ends, 80 characters at most, never empty."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, TUNING.slug_chars), F.lit("")), F.lit("untitled"))


def contains_ci(text: Column, part: Column) -> Column:
    """Case-insensitive containment, wildcards taken literally."""
    return F.contains(F.lower(text), F.lower(part))


def entity_key(name: Column) -> Column:
    """Lower case with ``/`` as ``-``."""
    return F.replace(F.lower(name), F.lit("/"), F.lit("-"))


def analysis_commit(content: Column) -> Column:
    """The commit that a note says it was reconciled with; null if it says none."""
    return F.nullif(F.regexp_extract(content, ANALYSIS_COMMIT, 1), F.lit(""))


def language_ok(text: Column) -> Column:
    """Few Cyrillic letters, or few against the Latin ones."""
    cyrillic = F.regexp_count(text, F.lit(r"[Ѐ-ӿ]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return (cyrillic <= TUNING.cyrillic_floor) | (cyrillic / (cyrillic + latin) <= TUNING.cyrillic_ratio)


def author(source: Column, created_by: Column) -> Column:
    """The agent named by ``source``, else created_by."""
    return F.when(source.startswith("agent:"), F.substring(source, 7, 1 << 20)).otherwise(created_by)


def authority(path: Column, kind: Column, status: Column, entity_type: Column, superseded_by: Column) -> Column:
    """How far a document is trusted: doctrine 1.3; closed tasks, indexes 0.5 and archives 0.3 multiply; superseded ones 0.4 at most."""
    kind, status = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(status, F.lit("")))
    one = F.lit(1.0)
    rule = path.startswith("projects/solution_designs/") | kind.isin("doctrine", "decision") | F.coalesce(entity_type == "Decision", F.lit(False))
    factor = (
        F.when(rule, F.lit(1.3)).otherwise(one)
        * F.when(kind.isin("task", "status") & status.isin("done", "closed", "resolved"), F.lit(0.5)).otherwise(one)
        * F.when(kind.isin("index", "moc"), F.lit(0.5)).otherwise(one)
        * F.when((kind == "archive") | path.startswith("archive/"), F.lit(0.3)).otherwise(one)
    )
    return F.when(F.coalesce(superseded_by, F.lit("")) != "", F.least(factor, F.lit(0.4))).otherwise(factor)


def overlapping_count(text: Column, part: str) -> Column:
    """Occurrences of a fragment, overlapping ones too."""
    import re

    return F.regexp_count(text, F.lit(f"(?={re.escape(part)})")) if part else F.lit(0)


def folder_key(path: Column) -> Column:
    """The first folder; solution designs are one of their own."""
    return F.when(path.startswith("projects/solution_designs/"), "projects/solution_designs").otherwise(F.split_part(path, F.lit("/"), F.lit(1)))


def pull_request_repo(text: Column) -> Column:
    """The repository named by the first pull request URL; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), PR_URL, 1), F.lit(""))


def route_of(url: Column, routes: list[str]) -> Column:
    """SRC8: the tracked route of a request URL; null for others."""
    path = F.split_part(url, F.lit("?"), F.lit(1))
    return F.when(path.isin(*routes), path).when(path.rlike("^/entity/[^/]+$"), F.lit("/entity/:id"))
