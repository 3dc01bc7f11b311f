"""Search queries over the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Knowledge
from ..functions.cells import vector_index
from ..functions.english import lexemes_sql
from ..functions.text import authority, rare_tokens
from ..functions.vocab import TUNING
from ..operators import search
from ..sources import catalog
from ..sources.io import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_MORE = [(100001, "licence CC BY-NC-SA 4.0 today"), (100002, "src3 7"), (100003, '"released under the mit license" -clown'), (100004, "idiot clown OR scum -trash")]


def _queries(spark, sf_dir):
    """The first four words of every benchmark item, and four literals, two of them in web syntax."""
    words = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    own = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("q"))
    more = spark.createDataFrame(_MORE, "query_id long, q string")
    return own.unionByName(more)


Q = f"""queries AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS q FROM benchmark
    UNION ALL SELECT * FROM (VALUES {', '.join(map(str, _MORE))}))"""
VECTOR = f"""vector AS (SELECT query_id, chunk_id, sim, rank FROM (SELECT a.item_id AS query_id, e.vec_id * 100000 AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS sim,
    row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
    FROM benchmark a JOIN embeddings q ON q.vec_id = a.item_id JOIN embeddings e ON e.vec_id IN (SELECT doc_id FROM documents)) WHERE rank <= {TUNING.candidates})"""
ENGLISH = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
_POSITIONED = f"flatten(list_transform(regexp_extract_all(lower(@), '{ENGLISH}'), lambda t: CASE WHEN contains(t, '-') THEN list_prepend(t, string_split(t, '-')) ELSE [t] END))"
#: What the web syntax of two of the queries means; in the others every word is a part of its own.
_PARTS = [(100003, 0, False, 0, "released under the mit license"), (100003, 0, True, 0, "clown"), (100004, 0, False, 0, "idiot"), (100004, 0, False, 1, "clown"), (100004, 1, False, 0, "scum"), (100004, 1, True, 0, "trash")]
TEXT = f"""spoken AS (SELECT chunk_id, len, unnest(p) AS term, unnest(range(len(p))) AS pos FROM (SELECT chunk_id, length(content) AS len, {_POSITIONED.replace("@", "content")} AS p FROM chunks)),
    parts AS (SELECT query_id, 0 AS alt, false AS neg, unnest(range(len(w))) AS item, unnest(w) AS words FROM (SELECT query_id, string_split_regex(q, '\\s+') AS w FROM queries WHERE query_id NOT IN (100003, 100004))
        UNION ALL SELECT * FROM (VALUES {', '.join(map(str, _PARTS))})),
    part_terms AS (SELECT query_id, alt, neg, item, unnest(p) AS term, unnest(range(len(p))) AS pos FROM (SELECT *, {_POSITIONED.replace("@", "words")} AS p FROM parts)),
    known AS (SELECT DISTINCT term FROM part_terms UNION SELECT DISTINCT term FROM spoken), stems AS MATERIALIZED ({lexemes_sql("known", "term")}),
    part_words AS (SELECT query_id, alt, neg, item, pos AS off, lexeme FROM part_terms JOIN stems USING (term) WHERE lexeme IS NOT NULL),
    asked_words AS (SELECT query_id, lexeme, count(*) OVER (PARTITION BY query_id) AS asked FROM (SELECT DISTINCT query_id, lexeme FROM part_words)),
    hits AS MATERIALIZED (SELECT query_id, asked, chunk_id, len, lexeme, pos FROM spoken JOIN stems USING (term) JOIN asked_words USING (lexeme)),
    part_hits AS (SELECT DISTINCT query_id, alt, neg, item, chunk_id FROM part_words JOIN hits USING (query_id, lexeme) JOIN (SELECT query_id, alt, neg, item, count(*) AS n FROM part_words GROUP BY ALL) USING (query_id, alt, neg, item)
        GROUP BY query_id, alt, neg, item, chunk_id, pos - off, n HAVING count(DISTINCT off) = n),
    alts AS (SELECT query_id, alt, count(DISTINCT item) AS must FROM part_words WHERE NOT neg GROUP BY ALL),
    fits AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, alt, chunk_id, count(*) FILTER (NOT neg) AS n, count(*) FILTER (neg) AS out FROM part_hits GROUP BY ALL) JOIN alts USING (query_id, alt) WHERE n = must AND out = 0),
    near_ AS (SELECT a.query_id, a.chunk_id, 1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.pos - b.pos) / 1.5::DOUBLE - 2)))))) AS w FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND a.lexeme < b.lexeme
        AND abs(a.pos - b.pos) BETWEEN 1 AND 100 GROUP BY a.query_id, a.chunk_id),
    any_ AS (SELECT query_id, chunk_id, len, asked, sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) * 0.1::DOUBLE / 1.64493406685::DOUBLE / asked AS w
        FROM (SELECT query_id, asked, chunk_id, len, lexeme, count(*) AS tf FROM hits GROUP BY ALL) GROUP BY query_id, chunk_id, len, asked),
    weighed AS (SELECT *, max(whole::INT) OVER (PARTITION BY query_id) AS has_fit FROM (SELECT query_id, chunk_id, len, f.chunk_id IS NOT NULL AS whole,
        round(CASE WHEN f.chunk_id IS NOT NULL AND asked > 1 AND (SELECT count(*) FROM alts WHERE alts.query_id = any_.query_id) = 1 THEN coalesce(near_.w, 0) ELSE any_.w END, 7) AS w FROM any_ LEFT JOIN fits f USING (query_id, chunk_id) LEFT JOIN near_ USING (query_id, chunk_id))),
    text_ AS (SELECT query_id, chunk_id, rank, CASE has_fit WHEN 1 THEN 'all' ELSE 'any' END AS mode FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, len, chunk_id) AS rank FROM weighed WHERE has_fit = 0 OR whole) WHERE rank <= {TUNING.candidates})"""
LOOSE = r"regexp_replace(lower({}), '[-_./\s]+', ' ', 'g')"
TITLE = f"""title_ AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, document_id * 100000 AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(title), document_id) AS rank
    FROM docs JOIN queries ON q <> '' AND (contains(lower(title), lower(q)) OR contains(lower(path), lower(replace(q, ' ', '-'))) OR (trim({LOOSE.format('q')}) <> '' AND
        (contains({LOOSE.format('title')}, trim({LOOSE.format('q')})) OR contains({LOOSE.format('path')}, trim({LOOSE.format('q')})))))) WHERE rank <= {TUNING.title_candidates})"""
RARE = r"""rare AS (SELECT query_id, q, list_filter(list_concat(list_filter(regexp_extract_all(q, '\d+(?:[.,]\d+)?%?'), lambda t: contains(t, '%') OR length(t) >= 3),
    list_filter(regexp_extract_all(q, '[A-Za-z][A-Za-z0-9]*(?:[-_./][A-Za-z0-9]+)+'), lambda t: length(t) >= 4)), lambda t: true)[1:6] AS toks FROM queries)"""
EXACT = f"""{RARE}, tok AS (SELECT query_id, unnest(toks) AS tok FROM rare), body AS (SELECT query_id, chunk_id, count(*) AS hits FROM chunks JOIN tok ON contains(lower(content), lower(tok)) GROUP BY ALL),
    named AS (SELECT DISTINCT query_id, document_id FROM docs JOIN tok ON contains(lower(title), lower(tok)) OR contains(lower(path), lower(tok))),
    hit AS (SELECT query_id, chunk_id, max(hits) AS hits FROM (SELECT * FROM body UNION ALL SELECT query_id, document_id * 100000, 0 FROM named) GROUP BY ALL),
    exact_ AS (SELECT query_id, chunk_id, rank, named, hits FROM (SELECT h.*, CASE WHEN n.document_id IS NULL THEN 0 ELSE 1 END AS named,
        row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n.document_id IS NULL THEN 0 ELSE 1 END DESC, hits DESC, length(content), chunk_id) AS rank
        FROM hit h JOIN chunks USING (chunk_id) LEFT JOIN named n USING (query_id, document_id)) WHERE rank <= {TUNING.exact_candidates})"""
FUSED = f"""fused_parts AS (SELECT query_id, chunk_id, 'vector' AS channel, 1.0::DOUBLE / ({TUNING.rrf_k} + rank) AS part, sim FROM vector UNION ALL SELECT query_id, chunk_id, 'text', 1.0::DOUBLE / ({TUNING.rrf_k} + rank), NULL FROM text_
    UNION ALL SELECT query_id, chunk_id, 'title', 3.0::DOUBLE / ({TUNING.rrf_k} + rank), NULL FROM title_ UNION ALL SELECT query_id, chunk_id, 'exact', 3.0::DOUBLE / ({TUNING.rrf_k} + rank), NULL FROM exact_),
    fused AS (SELECT query_id, chunk_id, round(sum(part), 7) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS matched_by, max(sim) AS similarity FROM fused_parts GROUP BY query_id, chunk_id)"""
GONE = "flagged AS (SELECT *, chunk_index = 0 AND document_id % 7 = 0 AS superseded FROM chunks)"
COLLAPSED = f"""{GONE}, collapsed AS (SELECT query_id, document_id, chunk_id, best, chunks_matched, superseded, matched_by, similarity FROM (SELECT f.*, document_id, superseded, max(score) OVER d AS best, count(*) OVER d AS chunks_matched,
    row_number() OVER (PARTITION BY query_id, document_id ORDER BY superseded, score DESC, chunk_id) AS n FROM fused f JOIN flagged USING (chunk_id) WINDOW d AS (PARTITION BY query_id, document_id)) WHERE n = 1)"""
FACTORS = """factors AS (SELECT document_id, path, CASE WHEN kind IN ('doctrine', 'decision') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN kind = 'archive' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS authority
    FROM (SELECT document_id, path, CASE max(quality) WHEN 1 THEN 'doctrine' WHEN 0 THEN 'archive' END AS kind FROM docs LEFT JOIN labels ON doc_id = document_id GROUP BY ALL))"""
HYBRID = f"""ranked AS (SELECT query_id, document_id, path, position, round(best * authority, 9) AS score, chunk_id, chunks_matched, matched_by, superseded FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(best * authority, 9) DESC, path) AS position
    FROM collapsed JOIN factors USING (document_id)) WHERE position <= 8)"""
ALL = f"{catalog.ctes('docs', 'chunks')}, {Q}, {VECTOR}, {TEXT}, {TITLE}, {EXACT}, {FUSED}, {COLLAPSED}, {FACTORS}, {HYBRID}"


def _vectors(spark, sf_dir):
    """(base, asked): the documents' vectors by chunk, and those of the benchmark's items."""
    vecs = load(spark, sf_dir, "embeddings")
    ids = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    base = vecs.join(ids, "vec_id", "left_semi").select((F.col("vec_id") * 100000).alias("chunk_id"), F.col("embedding").alias("vec"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(vecs, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vec"))
    return base, asked


def _vector(spark, sf_dir):
    return search.vector_channel(*_vectors(spark, sf_dir))


@query(f"WITH {VECTOR} SELECT query_id, chunk_id, sim, rank FROM vector")
def search_vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir).select("query_id", "chunk_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VECTOR} SELECT query_id, chunk_id, sim, rank FROM vector")
def search_vector_index(spark, sf_dir):
    base, asked = _vectors(spark, sf_dir)
    found = search.indexed_vector_channel(vector_index(base, k=TUNING.candidates, id_col="chunk_id"), asked, exact=True)
    return found.select("query_id", "chunk_id", "sim", F.col("rank").cast("long").alias("rank"))


@query(f"{catalog.ctes('docs', 'chunks')}, {Q}, {TEXT} SELECT query_id, chunk_id, rank FROM text_ WHERE mode = 'all'")
def search_text_all(spark, sf_dir):
    return search.text_channel(catalog.search_index(spark, sf_dir), _queries(spark, sf_dir)).where("mode = 'all'").select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"{catalog.ctes('docs', 'chunks')}, {Q}, {TEXT} SELECT query_id, chunk_id, rank, mode FROM text_")
def search_text_any_fallback(spark, sf_dir):
    return search.text_channel(catalog.search_index(spark, sf_dir), _queries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{catalog.ctes('docs')}, {Q}, {TITLE} SELECT query_id, chunk_id, rank FROM title_")
def search_title(spark, sf_dir):
    return search.title_channel(catalog.search_index(spark, sf_dir), catalog.chunks(spark, sf_dir), catalog.documents(spark, sf_dir), _queries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {Q}, {RARE} SELECT query_id, array_to_string(toks, '|') AS tokens FROM rare")
def rare_query_tokens(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", F.array_join(rare_tokens(F.col("q")), "|").alias("tokens"))


@query(f"{catalog.ctes('docs', 'chunks')}, {Q}, {EXACT} SELECT query_id, chunk_id, rank, named, hits FROM exact_")
def search_exact_tokens(spark, sf_dir):
    return search.exact_channel(catalog.search_index(spark, sf_dir), catalog.chunks(spark, sf_dir), _queries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def _fused(spark, sf_dir):
    i, c, d, q = catalog.search_index(spark, sf_dir), catalog.chunks(spark, sf_dir), catalog.documents(spark, sf_dir), _queries(spark, sf_dir)
    return search.fuse({"vector": _vector(spark, sf_dir), "text": search.text_channel(i, q), "title": search.title_channel(i, c, d, q), "exact": search.exact_channel(i, c, q)})


@query(f"{ALL} SELECT query_id, chunk_id, score, matched_by, similarity FROM fused")
def search_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 7))


def _flagged(spark, sf_dir):
    return catalog.chunks(spark, sf_dir).withColumn("superseded", (F.col("chunk_index") == 0) & (F.col("document_id") % 7 == 0))


@query(f"{ALL} SELECT query_id, document_id, chunk_id, best, chunks_matched, superseded, matched_by, similarity FROM collapsed")
def search_collapsed(spark, sf_dir):
    return search.collapse(_fused(spark, sf_dir), _flagged(spark, sf_dir)).drop("chunk_index")


def _factors(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("document_id")).agg(F.max("quality").alias("quality"))
    d = catalog.documents(spark, sf_dir).join(labels, "document_id", "left")
    kind = F.when(F.col("quality") == 1, "doctrine").when(F.col("quality") == 0, "archive")
    none = F.lit(None).cast("string")
    return d.select("document_id", "path", authority(F.col("path"), kind, none, none, none).alias("authority"))


@query(f"{catalog.ctes('docs')}, {FACTORS} SELECT authority, count(*) AS n FROM factors GROUP BY authority")
def search_authority(spark, sf_dir):
    return _factors(spark, sf_dir).groupBy("authority").agg(F.count("*").alias("n"))


def _hybrid(spark, sf_dir):
    return search.rank_documents(search.collapse(_fused(spark, sf_dir), _flagged(spark, sf_dir)), _factors(spark, sf_dir))


@query(f"{ALL} SELECT query_id, document_id, path, position, score, chunk_id, chunks_matched, matched_by, superseded FROM ranked")
def search_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "document_id", "path", F.col("position").cast("long").alias("position"), "score", "chunk_id", "chunks_matched", "matched_by", "superseded")


@query(f"""{ALL.replace(FACTORS, FACTORS.replace("kind IN ('doctrine', 'decision')", "kind = 'doctrine' OR (document_id % 3 = 0 AND title IS NOT NULL)").replace("SELECT document_id, path, CASE max", "SELECT document_id, path, title, CASE max"))}
    SELECT query_id, document_id, position, score, CASE WHEN document_id % 3 = 0 AND title IS NOT NULL THEN 'Decision' ELSE 'Note' END AS entity_type, CASE document_id % 4 WHEN 0 THEN 'bot' WHEN 1 THEN 'ann' END AS author,
    document_id % 4 = 0 AND document_id % 100 < 48 AS own_recent FROM ranked JOIN (SELECT document_id, title FROM docs) USING (document_id)""")
def knowledge_search(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("document_id")).agg(F.max("quality").alias("quality"))
    i, vecs = F.col("document_id"), load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = catalog.documents(spark, sf_dir).join(labels, "document_id", "left").withColumns({
        "kind": F.when(F.col("quality") == 1, "doctrine").when(F.col("quality") == 0, "archive"), "source": F.when(i % 4 == 0, "agent:bot"), "created_by": F.when(i % 4 == 1, "ann"),
        "updated_at": F.lit(catalog.AS_OF).cast("timestamp") - F.make_interval(hours=(i % 100).cast("int")),
    })
    named = d.select(F.concat(F.lit("b"), i).alias("entity_id"), F.lit("Decision").alias("type"), F.col("title").alias("name"), "document_id").where("document_id % 3 = 0")
    entities = d.select(F.concat(F.lit("a"), i).alias("entity_id"), F.lit("Note").alias("type"), F.concat(F.lit("x"), i).alias("name"), "document_id").unionByName(named)
    chunks = _flagged(spark, sf_dir).join(vecs, (F.col("chunk_index") == 0) & (i == F.col("vec_id")), "left").drop("vec_id")
    asked = _queries(spark, sf_dir).join(vecs.withColumnRenamed("embedding", "vec"), F.col("query_id") == F.col("vec_id"), "left").drop("vec_id")
    base = Knowledge(d, chunks, entities, relations=None, index=catalog.search_index(spark, sf_dir))
    return base.search(asked, agent="bot", as_of=catalog.AS_OF).select("query_id", "document_id", F.col("position").cast("long").alias("position"), "score", "entity_type", "author", "own_recent")


@query(f"""{ALL}, latest AS (SELECT document_id, arg_max(content, chunk_index) AS c FROM flagged WHERE NOT superseded GROUP BY document_id)
    SELECT query_id, document_id, CASE WHEN superseded THEN CASE WHEN length(c) > 500 THEN substr(c, 1, 500) || '…' ELSE c END END AS correction FROM ranked LEFT JOIN latest USING (document_id)""")
def search_correction(spark, sf_dir):
    return search.attach_corrections(_hybrid(spark, sf_dir), _flagged(spark, sf_dir)).select("query_id", "document_id", "correction")


@query("""SELECT query_id, document_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, document_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id // 5 AS document_id,
    max(round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id // 5
    WHERE q.vec_id % 100 = 0 AND round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) > 0.2 GROUP BY ALL)) WHERE rank <= 5""")
def similar_notes(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).cast("long").alias("document_id"), F.col("embedding").alias("vec"))
    asked = [(r.vec_id, list(r.embedding)) for r in e.where("vec_id % 100 = 0").toLocalIterator()]
    return search.similar_notes(base, asked, above=0.2).withColumn("rank", F.col("rank").cast("long"))
