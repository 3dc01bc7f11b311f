"""Codebooks, spelling variants and toxicity: against brute force, exact rules and held-out labels."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import codebooks, queries, spelling, toxicity

VECTORS = "vec_id long, embedding array<float>, label int, part int, code string, error int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], VECTORS)


def plainly(rows, parts=8, entries=16, rounds=6):
    """The contract with Python integers."""
    own = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(own[0][1])
    cut = [p * d // parts for p in range(parts + 1)]
    split = lambda v: [v[a:b] for a, b in zip(cut[:-1], cut[1:])]
    first = sorted(own, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[split(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    pick = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in own:
                x = split(v)[p]
                groups[pick(x, books[p])].append(x)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else books[p][e] for e in range(len(books[p]))]
    out, by_label = [], Counter()
    for i, v, lab in own:
        code = [pick(x, books[p]) for p, x in enumerate(split(v))]
        error = sum(far(x, books[p][code[p]]) for p, x in enumerate(split(v)))
        by_label[lab] += error
        out.append((i, "".join(f"{c:02x}" for c in code), error, lab))
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=str), books


def test_codebooks_against_plain_integers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)], rng.choice([1, 2, None])) for i in rng.sample(range(500), 90)]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[1][1], None), (1, None, 1), (2, [1.0] * 19 + [None], 1), (4, [1.0] * 19 + [float("nan")], 2), (5, [float("inf")] + [0.0] * 19, 2)]
    own = vectors(spark, rows)
    want, books = plainly(rows)
    got = codebooks.vector_codes(own).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {codebooks.digest([np.array(b) for b in books])}


def test_codebooks_match_sql(spark, sf):
    cols = "vec_id, code, error, label_error, codebooks_sha256"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {cols} FROM ({queries.ORACLE_SQL['op11_integer_codebooks']})").fetchall()
    got = [tuple(r) for r in queries.op11_integer_codebooks(spark, sf).select(*cols.split(", ")).collect()]
    assert sorted(got) == sorted(want) and len(got) == con.execute("SELECT count(*) FROM embeddings").fetchone()[0]


def test_codebooks_few_none_and_other_lengths(spark):
    rows = [(1, [1.0] * 8, None), (2, [1.0] * 8, 7), (3, [1.0] * 9, 7)]
    got = {r.vec_id: r for r in codebooks.vector_codes(vectors(spark, rows)).collect()}
    assert set(got) == {1, 2} and all(r.code == "00" * 8 and r.error == 0 and r.label_error == 0 for r in got.values())
    assert codebooks.vector_codes(vectors(spark, rows).limit(0)).count() == 0
    huge = codebooks.vector_codes(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])).collect()
    assert {r.error for r in huge} == {0}


def test_codebooks_decode(spark):
    rows = [(i, [i / 64 + k for k in range(8)], 1) for i in range(12)]
    own = vectors(spark, rows)
    books = codebooks.learn(own.select("vec_id", "embedding", "label"))
    back = {r.vec_id: r.approx for r in codebooks.decode(codebooks.encode(own, books), books).collect()}
    assert all(np.allclose(back[i], v) for i, v, _ in rows)  # 12 vectors have entries of their own


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abcé", 2), ("abcdefghij", 3)])
def test_near_pairs_against_all_pairs(spark, letters, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(250)}
    for w in list(words)[:80]:
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    words = sorted(w for w in words if len(w) >= 4)
    got = {(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_forms_and_roots(spark):
    rows = [("abcdef", 1000), ("abcdeg", 100), ("abcdgg", 20), ("abcggg", 5), ("zzzzzz", 9), ("abcdefz", 200), ("abcdefy", 200)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (got["abcggg"].form, got["abcggg"].root) == (None, "abcggg")  # 20 is less than five times 5 ... of its one near word
    assert (got["abcdgg"].form, got["abcdgg"].root, got["abcdgg"].form_n) == ("abcdeg", "abcdef", 100)
    assert (got["abcdeg"].form, got["abcdeg"].n_near) == ("abcdef", 2)
    assert (got["abcdefz"].form, got["abcdefz"].n_near) == ("abcdef", 2)
    assert (got["zzzzzz"].form, got["zzzzzz"].root, got["zzzzzz"].n_near, got["zzzzzz"].form_n) == (None, "zzzzzz", 0, None)


def test_occurrences(make):
    import re

    text = "Éa " + " ".join(f"Wörter{i % 3} über-alles x{i}y ÀÖÿ ÷×" for i in range(400))
    rows = [(1, text), (2, None), (3, ""), (None, "null Id Words"), (1, text)]
    want = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 5 == 0 else w] += 1
    got = Counter({r.word: r.n for r in spelling.occurrences(make(rows), every=5).groupBy("word").agg(toxicity.F.count("*").alias("n")).collect()})
    assert got == want


def test_spelling_odd_rows(odd):
    rows = {r.word: r.n for r in spelling.spelling_variants(odd).collect()}
    assert rows == {}  # no word of six letters occurs five times
    assert spelling.spelling_variants(odd.limit(0)).count() == 0


def chances(texts):
    c = toxicity.codes_of("\n".join(texts))
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    np.add.at(counts, (np.where(c[1:-1] > 0, c[:-2], 0) * toxicity.SYMBOLS + c[1:-1]) * toxicity.SYMBOLS + c[2:], 1)
    return toxicity.log_chances(counts)


CLEAN = ["the weather is good and the book tells of a little street where people meet", "a stupid idiot and a moron called him trash, a loser, a pathetic clown"] * 20


def test_restores_disguised_words():
    decoder = toxicity.Decoder(chances(CLEAN))
    seen = "what a stuuupid m0r0n, tr@sh: s.t.u.p.i.d and c l o w n, l-o-s-e-r! the book 1984 is good"
    (got,) = decoder.restore([seen])
    assert {"stupid", "moron", "trash", "clown", "loser", "book", "good"} <= set(toxicity.WORDS.findall(got)) and "1984" in got
    assert decoder.restore(["", "x", "The Book"]) == ["", "x", "the book"]


def test_viterbi_against_all_paths():
    import itertools

    decoder = toxicity.Decoder(chances(CLEAN))
    lm, n = decoder.lm, toxicity.SYMBOLS

    def value(parts):
        total, x, y = 0.0, 0, 0
        for text, cost in parts:
            total += cost
            for ch in text:
                c = toxicity.symbol(ch)
                total += lm[(x * n + y) * n + c] if c or y else 0
                x, y = (y, c) if c else (0, 0)
        return total + (lm[(x * n + y) * n] if y else 0)

    for span, spaced in (("m0r0n", False), ("1d1ott", False), ("s t u p", True), ("l.o$$er", False), ("bookk11", False)):
        lattice = decoder.lattice(span, spaced)
        best = max(itertools.product(*lattice), key=value)
        got = decoder.viterbi(lattice)
        assert got == "".join(t for t, _ in best)


def test_repeats_in_bulk_are_viterbi():
    decoder = toxicity.Decoder(chances(CLEAN))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaebllttto ..é") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    one_by_one = ["".join(p if p.isspace() else decoder.viterbi(decoder.lattice(p, False)) for p in __import__("re").split(r"([\s.]+)", t)) if "." not in t else None for t in texts]
    for got, want in zip(decoder.plain(texts), one_by_one):
        assert want is None or got == want


def test_toxicity_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.toxicities(docs, labels).collect()}
    out = [(rows[r.doc_id], r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    # A share of the toxic labels stands on texts without any mark; all others are found, and no clean text is.
    assert not any(r.predicted for r, y in out if y == 0)
    assert np.mean([r.predicted for r, y in out if y == 1]) > 0.6
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())


def test_disguised_documents_score_as_plain_ones(spark, make):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lm = toxicity.log_chances(toxicity.trigram_counts(docs))
    weights = toxicity.fit(docs, labels, ~toxicity.held_out(3, 1), lm)
    said = ["stupid", "idiot", "moron", "trash", "scum", "clown", "loser"]
    disguises = [lambda w: w, lambda w: w.translate(str.maketrans("oia", "014")), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w[:2] + w[2] * 4 + w[3:]]
    rows = [(i * 10 + k, f"Haorth thening, {f(w)} of the erin. {f(v)} onand.") for i, (w, v) in enumerate(zip(said, said[1:])) for k, f in enumerate(disguises)]
    got = {r.doc_id: r.score for r in toxicity.score(make(rows), weights, lm).collect()}
    found = [np.mean([got[i * 10 + k] >= 0.7 for i in range(len(said) - 1)]) for k in range(len(disguises))]
    assert found[0] == 1 and min(found) >= 0.8, found


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicities(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.toxicities(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicities(odd.limit(0), labels).count() == 0
    texts = {r.doc_id: r.restored for r in toxicity.restore(odd.where("doc_id < 9"), chances(CLEAN)).collect()}
    assert texts[1] is None and texts[2] == "" and texts[6] == "  \n\t " and texts[7] == "123 456 !!"


def test_kept_rows():
    rows, x = codebooks.finite(pa.array([[1.0, 2.0], None, [1.0], [None, 1.0], [float("inf"), 0.0], [3.0, 4.0]], pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0, 5] and x.tolist() == [[1, 2], [3, 4]]
