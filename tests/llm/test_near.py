import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_join, queries, suffix_dedup
from tessera.llm.decontaminate import leaks, slot_values, template


def brute(rows, n, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, families=6, members=25, words=60, edits=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(words + rng.randrange(20))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [f"w{rng.randrange(5000)}"], [own[k].upper(), "x"]])
            rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows) + k, t) for k, t in enumerate(["", None, "one", "One", "two words", " \t", rows[0][1].upper()])]


@pytest.mark.parametrize("seed,n,percent,leaf,tile", [(1, 4, 85, 32, 512), (2, 5, 80, 4, 8), (3, 2, 60, 4, 8)])
def test_ngram_classes(make, monkeypatch, seed, n, percent, leaf, tile):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "FAN", 2)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(make(rows), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_ngram_classes_odd_rows(odd):
    rows = ngram_join.ngram_classes(odd, 4, 85).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id}
    assert by[1] == (0, 1) and by[6] == (0, 6) and by[3] == (1, 3) and by[4] == (1, 3)
    assert ngram_join.ngram_classes(odd.limit(0), 4, 85).count() == 0


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(20, 60)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.r_[s[rng.random(len(s)) < 0.97], rng.integers(0, 400, 1).astype(np.uint64)]) for s in sets[:60]]
    n = np.array([len(s) for s in sets])
    vec = np.array([ngram_join.points(s) for s in sets])
    ids = np.arange(len(sets))
    want = {(i, j) for i in ids for j in ids if i < j and 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 70 * (n[i] + n[j] - o)}
    tree = lambda at: ngram_join.Tree(ids[at], n[at], ids[at], vec[at])
    assert len(tree(slice(0, None)).levels) == 2 and len(tree(slice(0, 40)).levels) == 2
    for split in (None, 77, 3):
        x, y = ngram_join.tree_join(tree(slice(0, None)), 70) if split is None else ngram_join.tree_join(tree(slice(0, split)), 70, tree(slice(split, None)))
        found = {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())}
        need = want if split is None else {(i, j) for i, j in want if (i < split) != (j < split)}
        assert need and need <= found


def test_longest_previous_factors():
    for text in (b"", b"a", b"aaaaaa", b"abracadabra abracadabra", bytes(np.random.default_rng(0).integers(97, 100, 120).astype(np.uint8))):
        order = suffix_dedup.suffix_array(text)
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
        lcp = suffix_dedup.common_prefixes(text, order)
        for later in (False, True):
            got = suffix_dedup.longest_previous_factors(order, lcp, later)
            for i in range(len(text)):
                others = range(i) if not later else range(i + 1, len(text))
                want = max((next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), 0) for j in others), default=0)
                assert got[i] == want


def covered_by(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mark[k : k + length] = True
        out.append((len(t), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mark])).hexdigest()))
    return out


@pytest.mark.parametrize("length,contexts", [(400, 64), (60, 64), (60, 1), (33, 3)])
def test_repeated_strings(make, monkeypatch, length, contexts):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", contexts)
    rng = random.Random(length + contexts)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(length // 3)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randrange(9) : len(passages[0]) - rng.randrange(9)] if rng.random() < 0.5 else " ".join(word() for _ in range(length // 4)) for _ in range(rng.randrange(1, 5))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], "a" * (3 * length), "ab" * length, "", None, "short", passages[0]]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(make(rows), length).collect()}
    assert got == dict(enumerate(covered_by(rows, length)))


def test_repeats_odd_rows(odd):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and [r.n_bytes for r in rows if r.doc_id == 1] == [0]
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0
    assert suffix_dedup.covered(b"x" * 50 + b"-" + b"x" * 30, 20) == [(0, 50), (51, 81)]
    assert suffix_dedup.covered(b"abcdefgh--abcdefgh", 8, keep_first=True) == [(10, 18)]


ITEMS = [
    (1, "A train leaves the town of Springfield at 45 km per hour and meets Another Person after 3 hours of travel on the line."),
    (2, "Short but complete question with words"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank while seven small birds are watching it."),
    (4, None),
    (5, ""),
]


def test_templates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Here comes Bob Stone with 5 km, or 3.5kg of it.",), (None,)], "t string")
    row, none = df.select(template(F.col("t")).alias("t"), slot_values(F.col("t")).alias("v")).collect()
    assert row.t == ["here", "comes", "", "with", "", "", "or", "", "", "of", "it"]
    assert row.v == ["bob stone", "5", "km", "3.5", "kg"] and none.t == [] and none.v == []


def test_leaks(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    other = "A train leaves the town of Shelbyville at 80 km per hour and meets Some Body after 7 hours of travel on the line."
    mixed = "A train leaves the town of Shelbyville at 80 km per hour and meets Shelbyville after 7 hours of travel on the line."
    rows = [
        (10, "Filler before. " + ITEMS[2][1].upper() + " Filler after."),
        (11, "See this. " + other),
        (12, "clean text about a train and the town that has nothing else to say about the question at all"),
        (13, None),
        (14, ""),
        (15, "some words. short BUT complete question with words! more words"),
        (16, "it says: " + mixed),
        (17, "the quick brown fox jumps over the lazy"),
        (18, ITEMS[2][1]),
        (18, ITEMS[2][1]),
    ]
    got = {(r.doc_id, r.item_id): r for r in leaks(make(rows), items).collect()}
    assert set(got) == {(10, 3), (11, 1), (15, 2), (18, 3)}
    assert got[11, 1].substituted == 4 and got[10, 3].coverage > 0.8
    assert leaks(make(rows).limit(0), items).count() == 0 and leaks(make(rows), items.limit(0)).count() == 0


TANK = "A tank holds 45 litres of water and a pump takes out 45 litres of it every 3 hours until the tank is empty."


def test_leak_behind_glued_number(spark, make):
    rows = [(1, "He came 2nd in it. " + TANK), (2, "COVID19, B2B, mp3. " + TANK), (3, TANK)]
    items = spark.createDataFrame([(1, TANK)], "item_id long, text string")
    assert {(r.doc_id, r.substituted) for r in leaks(make(rows), items).collect()} == {(1, 0), (2, 0), (3, 0)}


def test_as_many_values_as_slots(spark):
    from pyspark.sql import functions as F

    texts = [("He came 2nd, played mp3 files in B2B and had COVID19 with Bob2 at 5km.",), ("a\ue001 b\ue000 7 \ue002",), ("see 1" + ",1" * 50_000 + " of it " + "Word " * 50_000,)]
    for r in spark.createDataFrame(texts, "t string").select(template(F.col("t")).alias("t"), slot_values(F.col("t")).alias("v")).collect():
        assert len(r.v) == sum(t in "\ue000\ue001\ue002" for t in r.t) > 0


def test_leaks_by_any_alignment(spark, make):
    fruit = "How many pieces of fruit are in the old basket if there are 3 apples and 5 pears and 3 plums in it today?"
    items = spark.createDataFrame([ITEMS[0], (6, fruit)], "item_id long, text string")
    mixed = ITEMS[0][1].replace("Springfield", "Shelbyville").replace("Another Person", "Shelbyville")
    numbers = lambda a, b, c: f"How many pieces of fruit are in the old basket if there are {a} apples and {b} pears and {c} plums in it today?"
    rows = [(1, mixed), (2, mixed + " And then: " + ITEMS[0][1]), (3, numbers(4, 4, 4)), (4, numbers(7, 8, 9)), (5, numbers(3, 3, 5)), (6, fruit.replace("basket if", "and rather large basket if"))]
    got = {(r.doc_id, r.item_id): r.substituted for r in leaks(make(rows), items).collect()}
    assert got == {(2, 1): 0, (3, 6): 3, (4, 6): 3, (5, 6): 2, (6, 6): 0}


def test_leaks_in_any_case_and_layout(spark, make):
    tom = "Thomas has a red bag of apples. Thomas gives half of the apples to a friend. Thomas then eats a few of them. How many are left?"
    train = ITEMS[0][1]
    items = spark.createDataFrame([ITEMS[0], (7, tom)], "item_id long, text string")
    other = train.replace("Springfield", "Shelbyville").replace("Another Person", "Some Body").replace("45", "80")
    rows = [
        (1, "see: " + train.lower()), (2, train.upper()), (3, train.replace(" Springfield", "\nSpringfield").replace("Another Person", " Another\n\tPerson")),
        (4, other.replace("Shelbyville", '"Shelbyville"').replace("Some Body", "(Some Body)")), (5, other.replace(" Shelbyville", "\r\nShelbyville").replace(" Some Body", "  Some\u00a0Body")),
        (6, tom.replace("Thomas", "Annabel")), (7, "A train leaves the town at noon."),
    ]
    got = {(r.doc_id, r.item_id) for r in leaks(make(rows), items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 7)}


def test_window_hashes(spark):
    from tessera.llm.decontaminate import hashed

    words = [chr(97 + i % 5) * (1 + i % 3) for i in range(40)]
    (row,) = hashed(spark.createDataFrame([(words,)], "tok array<string>"), list(range(1, 9))).collect()
    for e in row.hs:
        runs = [tuple(words[i : i + e.len]) for i in range(40 - e.len + 1)]
        assert len(e.h) == len(runs) and len(set(zip(runs, e.h))) == len(set(runs)) == len(set(e.h))
    (short,) = hashed(spark.createDataFrame([(["a", "b"],)], "tok array<string>"), [2, 3, 8]).collect()
    assert [len(e.h) for e in short.hs] == [1, 0, 0]


def test_leaks_of_short_and_long_items(spark, make):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    items = spark.createDataFrame([(1, "What is 12 + 7?"), (2, " ".join(words)), (3, "3 * 4 = ?")], "item_id long, text string")
    rows = [
        (1, "Q: what is\n12+7 ? A: 19"), (2, "What is 12 - 7?"), (3, "What is 12 + 75?"), (4, "What is 12 + 7.5?"), (5, "so 3*4=12"), (6, "3, 4 and 5"),
        (7, "some " + " ".join(words[30:66]) + " more"), (8, "some " + " ".join(words[30:60]) + " more"), (9, "x".join(["some ", *[" ".join(words[i : i + 20]) + " " for i in range(0, 40, 20)]])),
    ]
    got = {(r.doc_id, r.item_id): r.coverage for r in leaks(make(rows), items).collect()}
    assert set(got) == {(1, 1), (5, 3), (7, 2)} and 0.2 < got[7, 2] < 0.5


def test_leaks_without_broadcast(spark, make, monkeypatch):
    import tessera.llm.decontaminate as d

    monkeypatch.setattr(d, "MOST_BROADCAST", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(make([(1, ITEMS[2][1]), (2, "nothing")]), items).collect()} == {(1, 3)}


def test_shingles_of_short_and_folded_texts():
    sets = [s for s, *_ in ngram_join.shingle_sets(pa.array(["a b c d", "A B C D", "a b c", "", "a b c d e"]), 4)]
    assert [len(s) for s in sets] == [1, 1, 1, 0, 2] and sets[0][0] == sets[1][0] != sets[2][0] and sets[0][0] in sets[4]


def first_kept(rows, length):
    """Brute force: bytes of each text covered by a string of ``length`` bytes that starts earlier."""
    seen, out = set(), {}
    for i, t in rows:
        t = (t or "").encode()
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                mark[k : k + length] = True
            seen.add(t[k : k + length])
        out[i] = int(mark.sum())
    return out


@pytest.mark.parametrize("contexts", [64, 1])
def test_first_copy_stays(make, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", contexts)
    rng = random.Random(contexts)
    passages = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(30)) for _ in range(3)]
    texts = [" ".join(rng.choice([*passages, f"own {rng.random()} words {rng.random()}"]) for _ in range(4)) for _ in range(25)] + ["z" * 200, "z" * 130, None, ""]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(make(rows), 60, keep_first=True).collect()}
    assert got == first_kept(rows, 60) and sum(got.values()) > 1000


def test_planted_passages(spark, sf, tmp_path):
    # Passages of over 50 words: of 400 bytes or more they go from every document, shorter ones stay. n_bytes tells neither, as it is the input's size.
    rng = random.Random(8)
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    alone = [k for k, got in enumerate(covered_by(rows, 400)) if not got[1]]
    long, short = (" ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(55)) for size in (8, 5))
    assert len(short) < 400 < len(long) and len(alone) > 100
    for passage, where in ((long, alone[:30]), (short, alone[30:60])):
        for k in where:
            i, text = rows[k]
            rows[k] = (i, f"{text[: len(text) // 2]} {passage} {text[len(text) // 2 :]}")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_suffix_repeats(spark, str(tmp_path)).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i, _ in rows)] == covered_by(rows, 400)
    assert all(got[i].n_bytes == len(t.encode()) for i, t in rows)
    assert all(got[rows[k][0]].n_spans == 1 and len(long) + 2 <= got[rows[k][0]].n_removed < len(long) + 20 for k in alone[:30])
    assert all(got[rows[k][0]].n_removed == 0 for k in alone[30:])


def test_repeats_of_one_identifier(make):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (1, " ".join(words[100:]) + " tail"), (None, " ".join(words[:120])), (None, "short"), (1, "short")]
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(make(rows), 100).collect())
    want = sorted(x[:2] for x in covered_by(rows, 100))
    assert got == want


def test_odd_sketches_lose_no_pair():
    rng = np.random.default_rng(5)
    for n, m, both in [(0, 5, 0), (40, 40, 40), (300, 320, 290), (700, 2500, 600), (5000, 4800, 4700), (30_000, 29_000, 28_000)]:
        h = rng.integers(0, 1 << 63, n + m - both).astype(np.uint64)
        a, b = ngram_join.odd_sketch(h[:n]), ngram_join.odd_sketch(h[n - both :])
        assert ngram_join.differing(a, b) == ngram_join.differing(b, a) <= n + m - 2 * both


@pytest.mark.parametrize("tile", [512, 16])
def test_near_misses_stay_in_their_tile(make, monkeypatch, tile):
    # Every two have a Jaccard index of 0.75 by their n-grams.
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(3)
    base = [f"w{rng.randrange(100_000)}" for _ in range(400)]
    rows = [(i, " ".join(base + [f"x{i}y{k}" for k in range(62)])) for i in range(60)]
    rows.append((60, rows[0][1] + " more"))
    made = []
    pairs = ngram_join.between
    monkeypatch.setattr(ngram_join, "between", lambda *a: made.append(pairs(*a)) or made[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(make(rows), 5, 80).collect()}
    assert got == brute(rows, 5, 80) and got[60][1] == 0
    assert sum(m.count() for m in made) < 60
