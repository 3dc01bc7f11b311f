"""Hybrid search over chunks: four channels, rank fusion, one result for each document.

A batch of queries is a DataFrame (query_id, q) of bounded size: MOST_QUERIES, which is checked. The lexical channels
read a SearchIndex, so no search scans texts. Chunks are (chunk_id, document_id, chunk_index, content[, superseded]); documents (document_id, path, title, ...).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.english import positioned, with_lexemes
from ..functions.text import analysis_commit, author, normalise_separators, rare_tokens
from ..functions.cells import VectorIndex
from ..functions.vectors import top_documents, top_similar
from ..functions.vocab import TUNING
from ..sources.io import ship, stage
from .contain import contained
from .postings import SearchIndex, read_index

MOST_QUERIES = 10_000
#: Rows (query, word) that are sent to every task at most; more are joined by a shuffle.
MOST_TERMS = 200_000
_TERM = re.compile(r"[^\W_]")


def checked(queries: DataFrame) -> DataFrame:
    """The queries, to be sent to every task: refused above MOST_QUERIES (search them in several batches)."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    return F.broadcast(queries)


def _ranked(df: DataFrame, k: int, *order) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(*order, "chunk_id")
    return df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def parse_web_query(q: str) -> list[dict]:
    """Alternatives of a query in web syntax, each with must and without (lists of words, and of quoted word sequences).

    Words must all occur; "quoted words" in that order; -word not at all. OR splits the query, it binds less than
    the words around it. Alternatives with nothing but exclusions are left out.
    """
    out = [{"must": [], "without": []}]
    for minus_quoted, quoted, minus, word in re.findall(r'(-?)"([^"]*)"|(-?)(\S+)', q):
        if word.upper() == "OR" and not minus:
            out.append({"must": [], "without": []})
        elif _TERM.search(quoted or word):
            out[-1]["without" if minus_quoted or minus else "must"].append((quoted or word).lower())
    return [a for a in out if a["must"]]


def _items(queries: DataFrame) -> DataFrame:
    """query_id, alternatives: each must and without, arrays of items; an item is an array of (off, lexeme), its words without the stop words.

    Queries are parsed on the driver, MOST_QUERIES at most.
    """
    spark = queries.sparkSession
    rows = [(r.query_id, n, kind, i, words) for r in queries.select("query_id", "q").collect() for n, a in enumerate(parse_web_query(r.q or "")) for kind in ("must", "without") for i, words in enumerate(a[kind])]
    said = spark.createDataFrame(rows, "query_id long, alt int, kind string, item int, words string")
    each = said.select("query_id", "alt", "kind", "item", F.posexplode(positioned(F.col("words"))).alias("off", "term"))
    each = with_lexemes(each)
    items = each.groupBy("query_id", "alt", "kind", "item").agg(F.sort_array(F.collect_list(F.struct("off", "lexeme"))).alias("words"))
    of = lambda kind: F.filter(F.collect_list(F.when(F.col("kind") == kind, F.col("words"))), lambda w: w.isNotNull()).alias(kind)
    alternatives = items.groupBy("query_id", "alt").agg(of("must"), of("without")).where(F.size("must") > 0)
    return alternatives.groupBy("query_id").agg(F.collect_list(F.struct("must", "without")).alias("alternatives"))


def _matches(at, item):
    """The words of an item stand at their places behind one another somewhere; ``at`` maps lexemes to positions."""
    first = F.get(item, F.lit(0))
    starts = F.coalesce(F.try_element_at(at, first["lexeme"]), F.array().cast("array<int>"))
    follows = lambda s: F.forall(item, lambda w: F.coalesce(F.array_contains(F.try_element_at(at, w["lexeme"]), s - first["off"] + w["off"]), F.lit(False)))
    return F.exists(starts, follows)


def _near_rank(found):
    """Rank of texts that have all of several words: 1 - product of (1 - weight), by the distances of all pairs of occurrences."""
    pairs = F.flatten(F.transform(found, lambda a, i: F.flatten(F.transform(F.slice(found, i + 2, F.size(found)), lambda b: F.flatten(F.transform(a["positions"], lambda x: F.transform(b["positions"], lambda y: F.abs(x - y))))))))
    weight = lambda d: F.when((d > 0) & (d <= 100), F.log(1 - 0.1 * F.sqrt(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))))).otherwise(F.lit(0.0))
    return 1 - F.exp(F.aggregate(pairs, F.lit(0.0), lambda total, d: total + weight(d)))


def _any_rank(found, asked):
    """Rank of texts that have some of the words: the sum of 1 / j^2 over a word's occurrences, over the words asked for."""
    one = lambda f: F.aggregate(F.sequence(F.lit(1), F.size(f["positions"])), F.lit(0.0), lambda total, j: total + 1.0 / (j * j))
    return F.aggregate(found, F.lit(0.0), lambda total, f: total + one(f)) * 0.1 / 1.64493406685 / asked


#: Chunks that are weighed together: a number for each of them and each query.
WEIGHED = 256


def _candidates(chunks: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, len, some, found of chunks (chunk_id, len, found: lexeme, positions): what can be among a query's first k.

    ``some`` is the weight by occurrences. A chunk that has all lexemes of an alternative may fit, so it goes on with what was
    found; of the others a task keeps k for each query. No row is made for every chunk and query that share a word.
    """
    ship(chunks.sparkSession)
    words: dict = {}
    sizes: dict = {}
    for r in asked.collect():  # MOST_TERMS rows at most; identifiers are integers
        words.setdefault(r.lexeme, []).append(sizes.setdefault(r.query_id, len(sizes)))
    names = list(sizes)
    # Every alternative: its query, and the lexemes that it can't do without.
    alternatives = [(sizes[r.query_id], {w.lexeme for i in a.must for w in i}) for r in items.collect() if r.query_id in sizes for a in r.alternatives]
    needs: dict = {}
    for n, (_, lexemes) in enumerate(alternatives):
        for w in lexemes:
            needs.setdefault(w, []).append(n)
    shared = chunks.sparkSession.sparkContext.broadcast((words, needs, names, [q for q, _ in alternatives], [len(w) for _, w in alternatives]))
    schema = "query_id long, chunk_id long, len int, some double, found array<struct<lexeme:string,positions:array<int>>>"

    def spread(rows, lexemes, table):
        """Of (row, lexeme) all (row, number of the table, place in rows)."""
        of = [table.get(w, ()) for w in lexemes]
        n = np.fromiter(map(len, of), np.int64, len(of))
        return np.repeat(rows, n), np.fromiter((x for xs in of for x in xs), np.int64, int(n.sum())), np.repeat(np.arange(len(of)), n)

    def run(batches):
        words, needs, names, owner, need = shared.value
        owner, need = np.array(owner, np.int64), np.array(need, np.int64)
        per = np.bincount(np.array([q for qs in words.values() for q in qs], np.int64), minlength=len(names))
        series = np.zeros(1)
        own = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("len", pa.int32()), ("some", pa.float64()), ("found", pa.list_(pa.struct([("lexeme", pa.string()), ("positions", pa.list_(pa.int32()))])))])
        out = lambda q, i, n, w, f: pa.RecordBatch.from_arrays([pa.array([names[x] for x in q], own.types[0]), pa.array(i, own.types[1]), pa.array(n, pa.int32()), pa.array(w, pa.float64()), pa.array(f, own.types[4])], schema=own)
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, rounded weight, len, chunk_id, weight
        floor, longest = np.full(len(names), -np.inf), np.full(len(names), np.iinfo(np.int64).max)
        for batch in batches:
            for start in range(0, batch.num_rows, WEIGHED):
                part = batch.slice(start, WEIGHED)
                found = part.column("found").to_pylist()
                ids, size = part.column("chunk_id").to_numpy(zero_copy_only=False), part.column("len").to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                lexeme = [w["lexeme"] for f in found for w in f]
                often = np.array([len(w["positions"]) for f in found for w in f], np.int64)
                if len(often) and often.max() >= len(series):
                    series = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 2 * often.max() + 1) ** 2)])
                r, q, at = spread(row, lexeme, words)
                weight = np.bincount(r * len(names) + q, series[often[at]], len(found) * len(names)).reshape(len(found), len(names)) * 0.1 / 1.64493406685 / np.maximum(per, 1)
                r, n, _ = spread(row, lexeme, needs)
                r, n = np.nonzero(np.bincount(r * len(need) + n, minlength=len(found) * len(need)).reshape(len(found), len(need)) == need)
                may = np.zeros(weight.shape, bool)
                may[r, owner[n]] = True
                r, q = np.nonzero(may)
                if len(r):
                    yield out(q, ids[r], size[r], weight[r, q], [[w for w in found[x] if y in words[w["lexeme"]]] for x, y in zip(r.tolist(), q.tolist())])
                r, q = np.nonzero((weight > 0) & ~may)
                w = np.round(weight[r, q], 7)
                ok = (w > floor[q]) | ((w == floor[q]) & (size[r] <= longest[q]))
                r, q, w = r[ok], q[ok], w[ok]
                if len(r):
                    best = [np.concatenate(x) for x in zip(best, (q, w, size[r], ids[r], weight[r, q]))]
                    order = np.lexsort((best[3], best[2], -best[1], best[0]))
                    best = [x[order] for x in best]
                    first = np.searchsorted(best[0], best[0])
                    rank = np.arange(len(first)) - first
                    best = [x[rank < k] for x in best]
                    last = np.flatnonzero(rank[rank < k] == k - 1)
                    floor[best[0][last]], longest[best[0][last]] = best[1][last], best[2][last]
        yield out(best[0], best[3], best[2], best[4], [None] * len(best[0]))

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("len").cast("int").alias("len"), "found").mapInArrow(run, schema)


def text_channel(index: SearchIndex, queries: DataFrame, k: int = TUNING.candidates) -> DataFrame:
    """Chunks that fit a query in web syntax; for queries without any such chunk, chunks with some of the words.

    Words are stemmed and stop words left out. Rank: by nearness where several words must all occur, else by
    occurrences (rounded to 7 places); then shorter, then chunk_id. Only the postings of the asked words are read.
    """
    checked(queries)
    asked = queries.select("query_id", F.explode(F.array_distinct(positioned(F.col("q")))).alias("term"))
    asked = stage(with_lexemes(asked).select("query_id", "lexeme").distinct(), "asked")
    posts = read_index(asked.sparkSession, index.terms, asked)
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("asked"))
    items = _items(queries)
    found = F.sort_array(F.collect_list(F.struct("lexeme", "positions"))).alias("found")
    positions = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")  # terms of one stem have postings of their own
    if asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        # Postings meet by chunk, once for all queries.
        hit = posts.join(F.broadcast(asked.select("lexeme").distinct()), "lexeme", "left_semi").repartition("chunk_id")
        own = _candidates(hit.groupBy("chunk_id", "len", "lexeme").agg(positions).groupBy("chunk_id", "len").agg(found), asked, items, k)
    else:
        # Beyond MOST_TERMS rows both sides are dealt by lexeme.
        hit = posts.join(asked, "lexeme").groupBy("query_id", "chunk_id", "len", "lexeme").agg(positions)
        own = hit.groupBy("query_id", "chunk_id", "len").agg(found).withColumn("some", F.lit(None).cast("double"))
    # One row for each of at most MOST_QUERIES queries.
    own = own.join(F.broadcast(sizes.join(items, "query_id", "left")), "query_id")
    at = F.map_from_entries(F.col("found"))
    fits = F.exists("alternatives", lambda a: F.forall(a["must"], lambda i: _matches(at, i)) & ~F.exists(a["without"], lambda i: _matches(at, i)))
    own = own.withColumn("full", F.coalesce(F.when(F.col("found").isNotNull(), fits), F.lit(False)))
    near = F.col("full") & (F.size("alternatives") == 1) & (F.col("asked") > 1)
    some = F.when(F.col("found").isNotNull(), _any_rank(F.col("found"), F.col("asked"))).otherwise(F.col("some"))
    own = own.withColumn("weight", F.round(F.when(near, _near_rank(F.col("found"))).otherwise(some), 7))
    # Chunks that fit come first, so the first k of all tell whether there are any; tasks keep k rows for each query.
    top = _ranked(own, k, F.desc("full"), F.desc("weight"), "len")
    any_full = F.max("full").over(Window.partitionBy("query_id"))
    kept = top.withColumn("_full", any_full).where("NOT _full OR full")
    return kept.select("query_id", "chunk_id", "rank", F.when(F.col("_full"), "all").otherwise("any").alias("mode"))


def vector_channel(base: DataFrame, queries: DataFrame, k: int = TUNING.candidates) -> DataFrame:
    """H2: nearest chunks by cosine; base (chunk_id, vec), queries (query_id, vec). Queries go in blocks of MOST_QUERIES, all of them."""
    vecs = [(r.query_id, list(r.vec)) for r in queries.where("vec IS NOT NULL").toLocalIterator()]
    parts = [top_similar(base, vecs[i : i + MOST_QUERIES], k, "chunk_id") for i in range(0, max(len(vecs), 1), MOST_QUERIES)]
    return functools.reduce(DataFrame.unionByName, parts).select("query_id", F.col("id").alias("chunk_id"), "rank", "sim")


def indexed_vector_channel(index: VectorIndex, queries: DataFrame, k: int = TUNING.candidates, exact: bool = False) -> DataFrame:
    """H2 over an index: the nearest of the cells that it probes, or of all rows with ``exact``."""
    vecs = [(r.query_id, list(r.vec)) for r in queries.where("vec IS NOT NULL").toLocalIterator()]
    parts = [index.search(vecs[i : i + MOST_QUERIES], k, exact=exact) for i in range(0, max(len(vecs), 1), MOST_QUERIES)]
    return functools.reduce(DataFrame.unionByName, parts).select("query_id", F.col("id").alias("chunk_id"), "rank", "sim")


def title_channel(index: SearchIndex, chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int = TUNING.title_candidates) -> DataFrame:
    """H4: first chunks of documents whose title or path has the query (as it is, with dashes, or with separators made equal)."""
    loose = F.trim(normalise_separators(F.col("q")))
    forms = {"title": F.lower("q"), "path": F.lower(F.replace("q", F.lit(" "), F.lit("-"))), "loose_title": loose, "loose_path": loose}
    q = checked(queries.where("q != ''")).select("query_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), n.alias("needle")) for f, n in forms.items()])).alias("n")).select("query_id", "n.*").where("needle != ''")
    hit = contained(index.grams, q).join(q, ["field", "needle"]).join(index.names, ["field", "text"])
    named = hit.select("query_id", "document_id").distinct().join(documents.select("document_id", "title"), "document_id")
    first = chunks.where("chunk_index = 0").select("chunk_id", "document_id")
    return _ranked(named.join(first, "document_id"), k, F.length("title")).select("query_id", "chunk_id", "rank")


def exact_channel(index: SearchIndex, chunks: DataFrame, queries: DataFrame, k: int = TUNING.exact_candidates) -> DataFrame:
    """Chunks with a rare token of the query; those whose title or path names one come first."""
    q = checked(queries).select("query_id", rare_tokens(F.col("q")).alias("rare")).where(F.size("rare") > 0)
    tok = q.select("query_id", F.explode(F.array_distinct(F.transform("rare", F.lower))).alias("needle"))
    needles = F.explode(F.array(*[F.lit(f) for f in ("run", "title", "path")])).alias("field")
    hit = stage(contained(index.grams, tok.select("needle", needles)), "held")
    in_run = hit.where("field = 'run'").select(F.col("text").alias("run"), "needle")
    # A token counts once for a chunk, however many of its runs hold it.
    body = index.runs.join(in_run, "run").select("chunk_id", "needle").distinct().join(F.broadcast(tok), "needle").groupBy("query_id", "chunk_id").agg(F.count("*").alias("hits"))
    named = hit.where("field != 'run'").join(index.names, ["field", "text"]).select("document_id", "needle").distinct().join(F.broadcast(tok), "needle")
    named = named.select("query_id", "document_id").distinct().withColumn("named", F.lit(1))
    where = chunks.select("chunk_id", "document_id", "chunk_index", F.length("content").alias("len"))
    first = where.where("chunk_index = 0").join(named, "document_id").select("query_id", "chunk_id").withColumn("hits", F.lit(0).cast("long"))
    all_hits = body.unionByName(first).groupBy("query_id", "chunk_id").agg(F.max("hits").alias("hits"))
    ranked = all_hits.join(where, "chunk_id").join(named, ["query_id", "document_id"], "left").withColumn("named", F.coalesce("named", F.lit(0)))
    return _ranked(ranked, k, F.desc("named"), F.desc("hits"), "len").select("query_id", "chunk_id", "rank", "named", "hits")


def fuse(channels: dict[str, DataFrame], k: int = TUNING.rrf_k) -> DataFrame:
    """By query and chunk the sum of weight / (k + rank), the channels in order, and the vector similarity."""
    weight = {"vector": TUNING.vector_weight, "text": TUNING.text_weight, "title": TUNING.title_weight, "exact": TUNING.exact_weight}
    parts = None
    for name, df in channels.items():
        sim = F.col("sim") if "sim" in df.columns else F.lit(None).cast("double")
        one = df.select("query_id", "chunk_id", F.lit(name).alias("channel"), (F.lit(weight[name]) / (F.lit(k) + F.col("rank"))).alias("part"), sim.alias("sim"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("matched_by"), F.max("sim").alias("similarity"))


def collapse(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each query and document: the best chunk's score, and the representative chunk.

    The representative is the best chunk that isn't superseded, else the best; text, channels and
    similarity come from it (K11).
    """
    gone = F.coalesce(F.col("superseded"), F.lit(False)) if "superseded" in chunks.columns else F.lit(False)
    rows = fused.withColumn("score", F.round("score", 7)).join(chunks.select("chunk_id", "document_id", "chunk_index", gone.alias("superseded")), "chunk_id")
    own = Window.partitionBy("query_id", "document_id")
    rows = rows.withColumns({"best": F.max("score").over(own), "chunks_matched": F.count("*").over(own)})
    pick = own.orderBy("superseded", F.desc("score"), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n", "score")


def rank_documents(collapsed: DataFrame, factors: DataFrame, limit: int = 8) -> DataFrame:
    """H7, T5: best score times authority, the first ``limit`` for each query; factors (document_id, path, authority)."""
    scored = collapsed.join(factors, "document_id").withColumn("score", F.round(F.col("best") * F.col("authority"), 9))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("position", F.row_number().over(top)).where(F.col("position") <= min(max(limit, 1), 50))


def document_types(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, entity_type: of a document's entities the one whose name is the title, else the first by id."""
    own = entities.where("document_id IS NOT NULL").select("document_id", "entity_id", "type", "name").join(documents.select("document_id", "title"), "document_id")
    first = F.min_by("type", F.struct((~F.coalesce(F.col("name") == F.col("title"), F.lit(False))).alias("other"), "entity_id"))
    return own.groupBy("document_id").agg(first.alias("entity_type"))


def describe(results: DataFrame, chunks: DataFrame, documents: DataFrame, agent: str | None = None, as_of: str | None = None) -> DataFrame:
    """Results with content, title, kind, tags, author, updated_at, analysis_commit and own_recent.

    own_recent: the caller ``agent`` wrote the note and it changed less than own_hours before ``as_of``. Columns that
    the documents don't have are null.
    """
    have = lambda c, kind="string": F.col(c) if c in documents.columns else F.lit(None).cast(kind)
    tags = F.array("tags") if dict(documents.dtypes).get("tags") == "string" else have("tags", "array<string>")
    d = documents.select("document_id", "title", have("kind").alias("kind"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), author(have("source"), have("created_by")).alias("author"), have("updated_at", "timestamp").alias("updated_at"), analysis_commit(have("content")).alias("analysis_commit"))
    out = results.join(chunks.select("chunk_id", "content"), "chunk_id").join(d, "document_id")
    recent = F.col("updated_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {TUNING.own_hours} HOURS")
    own = F.coalesce((F.col("author") == agent) & recent, F.lit(False)) if agent and as_of else F.lit(False)
    return out.withColumn("own_recent", own)


def attach_corrections(results: DataFrame, chunks: DataFrame, most: int = TUNING.correction_chars) -> DataFrame:
    """For superseded representatives the document's latest chunk that isn't, cut to 500 characters."""
    latest = chunks.where(~F.coalesce("superseded", F.lit(False))).join(results.where("superseded").select("document_id").distinct(), "document_id", "left_semi")
    latest = latest.groupBy("document_id").agg(F.max_by("content", "chunk_index").alias("_c"))
    cut = F.when(F.length("_c") > most, F.concat(F.substring("_c", 1, most), F.lit("…"))).otherwise(F.col("_c"))
    return results.join(latest, "document_id", "left").withColumn("correction", F.when(F.col("superseded"), cut)).drop("_c")


def similar_notes(base: DataFrame, queries: list[tuple], above: float = TUNING.similar_above, limit: int = TUNING.similar_limit) -> DataFrame:
    """Documents (base: id, document_id, vec) whose best chunk is close to a query vector; the document asked about is left out by the caller's id. All chunks count: tasks reduce them to documents."""
    best = top_documents(base, queries, above, limit).groupBy("query_id", "document_id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "document_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def context_markdown(edges: DataFrame, names: DataFrame) -> DataFrame:
    """For each entity its edges out and in as markdown lines, in order."""
    src, dst = names.select(F.col("entity_id").alias("src"), F.col("name").alias("sn")), names.select(F.col("entity_id").alias("dst"), F.col("name").alias("dn"))
    both = edges.join(src, "src").join(dst, "dst")
    out = both.select(F.col("src").alias("entity_id"), F.format_string("- %s -> %s", "type", "dn").alias("line"))
    back = both.select(F.col("dst").alias("entity_id"), F.format_string("- %s <- %s", "type", "sn").alias("line"))
    return out.unionByName(back).groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("markdown"), F.count("*").alias("lines"))
