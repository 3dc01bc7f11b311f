"""Notes and logs from files (SRC1-SRC3, SRC8, SRC9)."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import route_of
from ..functions.vocab import SKIPPED_FOLDERS, TRACKED_ROUTES
from .io import ship

REQUEST_LINE = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("msg", T.StringType()),
        T.StructField("req", T.StructType([T.StructField("url", T.StringType()), T.StructField("method", T.StringType())])),
    ]
)


def wanted(path: Column) -> Column:
    """A note's relative path: no hidden or skipped folder in it."""
    parts = F.split(path, "/")
    return path.endswith(".md") & ~F.exists(parts, lambda s: s.startswith(".") | s.isin(*SKIPPED_FOLDERS))


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """SRC1, SRC2: path (relative), raw (text), modified, for every note below root; no listing on the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(base) + 1})")
    rel = F.replace(rel, F.lit("%20"), F.lit(" "))
    return files.select(rel.alias("path"), F.col("content").cast("string").alias("raw"), F.col("modificationTime").alias("modified")).where(wanted(F.col("path")))


def parse_frontmatter(text: str) -> dict:
    """The subset of YAML that notes use: scalars, quoted strings, inline and dashed lists, one level of keys."""
    out: dict = {}
    key = None

    def scalar(v: str):
        v = v.strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            return v[1:-1]
        if v.startswith("[") and v.endswith("]") and not v.startswith("[["):
            return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", v[1:-1]) if x.strip()]
        low = v.lower()
        if low in ("true", "false"):
            return low == "true"
        if low in ("", "null", "~"):
            return None
        return v

    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*-\s+(.*)$", line):
            if key is not None:
                out[key] = [*(out[key] if isinstance(out[key], list) else []), scalar(m[1])]
        elif m := re.match(r"([A-Za-z_][\w -]*):(.*)$", line):
            key = m[1].strip()
            out[key] = scalar(m[2])
    return out


def with_frontmatter(notes: DataFrame) -> DataFrame:
    """SRC3: notes (path, raw) with frontmatter (JSON text) and body; without a leading block it is {} and the whole."""
    raw = F.replace(F.coalesce("raw", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    block = F.regexp_extract(raw, r"(?s)^---\n(.*?)\n?---(?:\n|$)", 1)
    has = raw.rlike(r"(?s)^---\n.*?\n?---(?:\n|$)")
    body = F.when(has, F.regexp_replace(raw, r"(?s)^---\n.*?\n?---(?:\n|$)", "")).otherwise(raw)
    split = notes.withColumn("_front", F.when(has, block).otherwise("")).withColumn("body", body)
    ship(notes.sparkSession)

    @F.arrow_udf("string")
    def to_json(column: pa.Array) -> pa.Array:
        return pa.array([json.dumps(parse_frontmatter(x or "")) for x in column.to_pylist()], pa.string())

    return split.withColumn("frontmatter", F.when(F.col("_front") == "", "{}").otherwise(to_json("_front"))).drop("_front")


def request_log(lines: DataFrame) -> DataFrame:
    """SRC8: usage events from JSON log lines (column ``value``): tracked requests only; unreadable lines are skipped."""
    entry = F.from_json("value", REQUEST_LINE, {"mode": "PERMISSIVE"})
    rows = lines.where(F.col("value").contains('"incoming request"')).select(entry.alias("e")).where("e.req.url IS NOT NULL AND e.req.method IS NOT NULL AND coalesce(e.time, 0) != 0")
    return rows.select(
        F.timestamp_millis("e.time").alias("ts"), route_of(F.col("e.req.url"), TRACKED_ROUTES).alias("endpoint"), F.col("e.req.method").alias("method"),
        F.lit(None).cast("int").alias("status"), F.lit(None).cast("int").alias("duration_ms"), F.lit(None).cast("string").alias("agent"),
    ).where("endpoint IS NOT NULL")


def golden_checks(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: retrieval checks from a JSON array."""
    return spark.read.schema("kind string, query string, expectPathIncludes string, topN int, service string, expectTopic string, minConsumers int, entity string, minEdges int").json(path, multiLine=True)
