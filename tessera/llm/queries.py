"""The registered query of each corpus operator, and SQL where SQL can express it."""

from __future__ import annotations

from .common import table


def op1_hilbert_shards(spark, sf_dir):
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op2_language_codes(spark, sf_dir):
    from .language import languages

    return languages(table(spark, sf_dir, "documents"))


def op3_warc_split(spark, sf_dir):
    from .warc import pages_by_archive

    return pages_by_archive(table(spark, sf_dir, "pages"))


def op4_template_leaks(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_attention_quality(spark, sf_dir):
    from .quality import qualities

    return qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op7_count_vector_join(spark, sf_dir):
    from .ngram_join import ngram_classes

    return ngram_classes(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_suffix_repeats(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op9_token_records(spark, sf_dir):
    from .records import token_records

    return token_records(table(spark, sf_dir, "documents"), end_id=2)


def op10_best_fit(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op11_integer_codebooks(spark, sf_dir):
    from .codebooks import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_noisy_channel(spark, sf_dir):
    from .toxicity import toxicities

    return toxicities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_groups(spark, sf_dir):
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def _codebook_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round is a pair of tables: the nearest entries, and the codebooks made from them."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM v, range({parts}) r(p)),
        c0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) USING (vec_id) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, x, min(struct_pack(d, e)) AS best FROM (SELECT vec_id, p, x, e,
            list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{r} USING (p)) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, best.e AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))""")
    return f"""WITH {", ".join(steps)},
        o AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        s AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS s FROM (SELECT p, e, array_to_string(c, ',') AS t FROM c{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM o JOIN v USING (vec_id), s"""


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_language_codes, op3_warc_split, op4_template_leaks, op5_attention_quality, op6_exact_dedup, op7_count_vector_join, op8_suffix_repeats, op9_token_records, op10_best_fit, op11_integer_codebooks, op12_noisy_channel, op13_spelling_groups)}

ORACLE_SQL = {
    "op7_count_vector_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op3_warc_split": """
        WITH t AS (
          SELECT page_id, url, encode(coalesce(html, '')) AS p FROM pages),
        d AS (SELECT page_id, url, octet_length(p) AS payload_bytes, sha256(p) AS payload_digest FROM t),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, url
        FROM g""",
    "op6_exact_dedup": """
        WITH t AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_integer_codebooks": _codebook_sql(),
    "op13_spelling_groups": r"""
        WITH RECURSIVE bits AS (SELECT i AS b, list_reduce(range(8), lambda c, k: CASE c % 2 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS t FROM range(256) r(i)),
        crc AS MATERIALIZED (SELECT list(t ORDER BY b) AS t FROM bits),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
        each AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM runs GROUP BY ALL),
        h AS (SELECT w, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295) AS h FROM each, crc),
        words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM h)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.d = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.d = w.word),
        best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM (SELECT word, other, n AS m FROM near JOIN (SELECT word AS other, n FROM words) USING (other)) GROUP BY word),
        f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
        r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
        SELECT word, form, arg_max(root, k) AS root, n, n_near, form_n FROM f JOIN r USING (word) GROUP BY ALL""",
}
