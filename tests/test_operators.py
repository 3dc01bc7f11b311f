import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.operators import audit, contain, dedup, extract, graph, postings, search, usage
from tessera.streaming import freshness


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_text_functions(spark):
    f = lambda g, s: one(spark, g(F.col("s")), s=s)
    assert f(text.rare_tokens, "take 12 or 123 or 5% of BY-NC and a/b and svc_x.y 1.5 7%") == ["123", "5%", "1.5", "7%", "BY-NC", "svc_x.y"]
    assert f(text.slug, "  Hello, World! ") == "hello-world" and f(text.slug, "??") == "untitled" and len(f(text.slug, "x" * 200)) == 80
    assert f(text.normalise_separators, "A-b__c / D") == "a b c d"
    assert f(text.analysis_commit, "analysis-commit: abc1234 x") == "abc1234" and f(text.analysis_commit, "none") is None
    assert f(text.language_ok, "слово " * 20) is False and f(text.language_ok, "слово " * 5) is True
    assert f(text.pull_request_repo, "x https://github.com/o/my-repo.git/pull/3") == "my-repo" and f(text.pull_request_repo, None) is None
    assert f(text.folder_key, "projects/solution_designs/x.md") == "projects/solution_designs" and f(text.folder_key, "a/b.md") == "a"
    assert one(spark, text.overlapping_count(F.col("s"), "aa"), s="aaaa") == 3
    assert one(spark, text.author(F.col("a"), F.col("b")), a="agent:x", b="y") == "x" and one(spark, text.author(F.col("a"), F.col("b")), a=None, b="y") == "y"


def test_authority(spark):
    def factor(path="n/a.md", kind=None, status=None, etype=None, gone=None):
        return one(spark, text.authority(*(F.col(c) for c in "pkseg")), p=path, k=kind, s=status, e=etype, g=gone)

    assert factor() == 1 and factor(kind="Doctrine") == 1.3 and factor(etype="Decision") == 1.3
    assert factor(kind="task", status="done") == 0.5 and factor(kind="task", status="open") == 1
    assert math.isclose(factor("archive/x.md", kind="decision"), 1.3 * 0.3) and factor(kind="decision", gone="d2") == 0.4
    assert math.isclose(factor("archive/x.md", gone="d"), 0.3)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vec array<double>")
    u = v / np.where(np.linalg.norm(v, axis=1) == 0, np.nan, np.linalg.norm(v, axis=1))[:, None]
    sim = u @ u.T
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, 0.5, blocks=3).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if sim[i, j] > 0.5}
    top = vectors.top_similar(df, [(1, v[3].tolist()), (2, [0.0] * 8)], 5).collect()
    want = sorted((-round(s, 6), i) for i, s in enumerate(sim[3]) if not np.isnan(s))[:5]
    assert [(r.query_id, r.id) for r in sorted(top, key=lambda r: r.rank)] == [(1, i) for _, i in want]
    norm = df.where("id = 3").select(vectors.norm(vectors.truncate(F.col("vec"), 4))).first()[0]
    assert math.isclose(norm, 1)
    assert df.where("id = 7").select(vectors.cosine(F.col("vec"), F.col("vec"))).first()[0] is None
    docs = spark.createDataFrame([("a b",), (None,)], "t string")
    out = vectors.embed(docs, "t", vectors.HashingEmbedder(16)).collect()
    assert len(out[0].embedding) == 16 and set(out[1].embedding) == {0.0}


def test_collapse_takes_text_from_the_representative(spark):
    fused = spark.createDataFrame([(1, 10, 0.5, "text", None), (1, 11, 0.3, "vector", 0.9), (1, 20, 0.4, "title", None)], "query_id long, chunk_id long, score double, matched_by string, similarity double")
    chunks = spark.createDataFrame([(10, 1, 0, True, "old"), (11, 1, 1, False, "new"), (20, 2, 0, False, "x")], "chunk_id long, document_id long, chunk_index int, superseded boolean, content string")
    rows = {r.document_id: r for r in search.collapse(fused, chunks).collect()}
    assert (rows[1].best, rows[1].chunk_id, rows[1].chunks_matched, rows[1].matched_by) == (0.5, 11, 2, "vector")
    factors = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.0)], "document_id long, path string, authority double")
    ranked = search.rank_documents(search.collapse(fused, chunks), factors, 1).collect()
    assert [r.document_id for r in ranked] == [2]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "USES"), ("b", "c", "USES"), ("d", "c", "CALLS_HTTP"), ("x", "y", "USES")], "src string, dst string, type string")
    roots = spark.createDataFrame([("a",)], "entity_id string")
    near = lambda h, t=None: {(r.src, r.dst) for r in graph.neighbourhood(edges, roots, h, t).collect()}
    assert near(1) == {("a", "b")} and near(2) == {("a", "b"), ("b", "c")} and near(3) == {("a", "b"), ("b", "c"), ("d", "c")}
    assert near(9, ["USES"]) == {("a", "b"), ("b", "c")} and near(0) == {("a", "b")}
    assert graph.neighbourhood(edges, roots, 3, cap=2).count() == 2
    comp = {r.node: r.comp for r in graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long")
    assert {r.comp for r in graph.components(chain).collect()} == {0}
    try:
        graph.neighbourhood(edges, roots, 1, ["bad type"])
        raise AssertionError
    except ValueError:
        pass


def test_dedup_labels(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, True), (2, 3, 0.95, True), (4, 5, 0.9, False)], "a long, b long, sim double, kept boolean")
    when = spark.createDataFrame([(1, 5), (2, 1), (3, 2), (4, 1), (5, 1)], "id long, updated_at int")
    rows = {r.id: (r.cluster, r.canonical, r.label) for r in dedup.clusters(pairs, when).collect()}
    assert rows == {1: (1, 1, "canon"), 2: (1, 1, "0.900"), 3: (1, 1, "trans")}


def test_extraction(spark):
    answer = 'Sure: {"objects": [{"type": "Decision", "name": "N", "summary": "s", "confidence": 0.5}], "relations": []} done'

    class Fixed:
        def __call__(self, text):
            return {"good": answer, "bad": "no json", "odd": '{"objects": [{"type": "Nope", "name": "N", "summary": "s", "confidence": 2}], "relations": []}'}[text]

    import pyspark.cloudpickle as cp
    import sys as _s

    cp.register_pickle_by_value(_s.modules[__name__])
    docs = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "odd")], "document_id string, content string")
    got = extract.extract(docs, Fixed()).collect()
    assert [(r.document_id, r.objects[0].name) for r in got] == [("1", "N")]
    ents = spark.createDataFrame([("e", ["agents/a.md"], "agent")], "entity_id string, sources array<string>, origin string")
    moved = extract.repoint(ents, "agents/a.md", "notes/a.md").first()
    assert (moved.sources, moved.origin) == (["notes/a.md"], "human")
    merged = extract.merge_sources(ents, spark.createDataFrame([("e", "agents/b.md"), ("e", "agents/a.md")], "entity_id string, path string")).first()
    assert (merged.sources, merged.origin) == (["agents/a.md", "agents/b.md"], "agent")


def test_audit(spark):
    notes = spark.createDataFrame([("a", "one $1 two"), ("b", "x x"), ("c", "none"), ("d", "same")], "path string, content string")
    edits = spark.createDataFrame([("a", "$1", "$2\\"), ("b", "x", "y"), ("c", "z", "y")], "path string, old_fragment string, new_fragment string")
    got = {r.path: (r.content, r.outcome) for r in audit.apply_edits(notes, edits).collect()}
    assert got == {"a": ("one $2\\ two", "edited"), "b": ("x x", "ambiguous"), "c": ("none", "missing"), "d": ("same", "untouched")}
    log = spark.createDataFrame(
        [(1, "a", "replace", datetime(2024, 1, 1), None, None), (2, "a", "append", datetime(2024, 1, 2), None, None), (3, "b", "promote", datetime(2024, 1, 2), None, None)],
        "edit_id int, path string, edit_kind string, created_at timestamp, reverted_at timestamp, reverted_by string",
    )
    assert [r.edit_id for r in audit.undo(log, "me", "2024-02-01").where("reverted_by = 'me'").collect()] == [2]
    new = spark.createDataFrame([(1, "f", "My Note"), (2, "f", "my note"), (3, "f", "Other")], "note_id int, folder string, title string")
    taken = spark.createDataFrame([("f/my-note.md",)], "path string")
    assert [r.path for r in audit.free_paths(new, taken).orderBy("note_id").collect()] == ["f/my-note-2.md", "f/my-note-3.md", "f/other.md"]
    assert audit.note_problem("t", "idea") is None and audit.note_problem("t", "x") and audit.note_problem(" ", "idea") and audit.note_problem("t" * 91, "idea")
    assert "source: \"agent:bot\"" in audit.provenance_note("T", "b", "bot", "idea", ["x", "x"], "2024-01-01")


def test_usage_edges(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    assert {r.p: r.value for r in usage.floor_percentile(rows, "v", [0, 50, 95, 100]).collect()} == {0: 0.0, 50: 5.0, 95: 9.0, 100: 9.0}
    assert usage.floor_percentile(rows.where("v < 0"), "v", [50]).count() == 0


def test_stream_debounce_and_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join('{"path": "%s", "action": "%s", "ts": "2024-01-01T00:00:%s"}' % x for x in [("a", "add", "00.0"), ("a", "change", "00.3"), ("b", "add", "00.1"), ("a", "unlink", "05.0")]))
    (folder / "2.json").write_text('{"path": "z", "action": "add", "ts": "2024-01-01T01:00:00.0"}')
    stream = freshness.note_stream(spark, str(folder)).withColumn("ts", F.col("ts"))
    q = freshness.debounced(stream).writeStream.format("memory").queryName("burst").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.path, r.action, r.events) for r in spark.table("burst").collect())
    assert got == [("a", "change", 2), ("a", "unlink", 1), ("b", "add", 1)]
    batch = spark.read.schema("path string, action string, ts timestamp").json(str(folder))
    assert freshness.once_per_key(batch, "path").count() == 3


def test_failed_rows_come_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []

    def handle(batch):
        seen.append(sorted(r.path for r in batch.collect()))
        return batch.where("path = 'bad'") if len(seen) == 1 else batch.limit(0)

    (folder / "1.json").write_text('{"path": "bad", "action": "add", "ts": "2024-01-01T00:00:00"}\n{"path": "ok", "action": "add", "ts": "2024-01-01T00:00:00"}')
    for n in (1, 2):
        freshness.run_batches(freshness.note_stream(spark, str(folder)), handle, str(tmp_path / "retry"), str(tmp_path / "cp"), once=True).awaitTermination()
        (folder / "2.json").write_text('{"path": "new", "action": "add", "ts": "2024-01-01T00:01:00"}')
    assert seen == [["bad", "ok"], ["bad", "new"]]


def test_web_queries(spark):
    parse = search.parse_web_query
    assert parse('a "b c" -d') == [{"must": ["a", "b c"], "without": ["d"]}]
    assert [x["must"] for x in parse("a OR b c")] == [["a"], ["b", "c"]]  # OR binds less than the words around it
    assert parse("") == [] and parse("-x") == [] and parse("OR OR") == []
    rows = [(1, "red fox and blue bird"), (2, "blue fox, red bird"), (3, "green fox"), (4, None), (5, "the foxes were running over red-hot stones"), (6, "stones that run hot")]
    chunks = spark.createDataFrame([(i, i, 0, t, "t") for i, t in rows], "chunk_id long, document_id long, chunk_index int, content string, title string")
    index = postings.search_index(chunks, chunks.select("document_id", "title", F.lit("p").alias("path")))
    asked = {1: '"red fox"', 2: "fox -green -stone", 3: "green OR bird", 4: "fox bird -blue", 5: "RUNS stone", 6: '"run over"', 7: "red-hot", 8: "the of", 9: '"foxes were running"', 10: '"foxes running"', 11: "-fox", 12: "zebra"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, q string")
    got = {}
    for r in search.text_channel(index, queries).collect():
        got.setdefault((r.query_id, r.mode), set()).add(r.chunk_id)
    full = {q: c for (q, m), c in got.items() if m == "all"}
    # Stop words at the end of a quotation ask for nothing (6), between words they take a place (9, 10).
    assert full == {1: {1}, 2: {1, 2}, 3: {1, 2, 3}, 5: {5, 6}, 6: {5, 6}, 7: {5}, 9: {5}}
    # Without any chunk that fits, those with some of the words come.
    assert got[4, "any"] == {1, 2, 3, 5} and got[10, "any"] == {1, 2, 3, 5, 6} and got[11, "any"] == {1, 2, 3, 5}


def test_nearness_ranks(spark):
    chunks = spark.createDataFrame([(1, "apple " + "filler " * 8 + "pear"), (2, "apple filler pear"), (3, "apple pear"), (4, "apple apple apple"), (5, "pear plum")], "chunk_id long, content string")
    docs = chunks.select(F.col("chunk_id").alias("document_id"), F.lit("t").alias("title"), F.lit("p").alias("path"))
    index = postings.search_index(chunks, docs)
    got = {}
    for r in search.text_channel(index, spark.createDataFrame([(1, "apples pears"), (2, "apple kiwi")], "query_id long, q string")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [3, 2, 1], 2: [4, 3, 2, 1]}


def test_index_is_pruned_and_kept_up(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"common word{i} text") for i in range(200)], "chunk_id long, content string")
    path = str(tmp_path / "terms")
    postings.write_index(chunks, path)
    one = spark.createDataFrame([("word7",)], "lexeme string")
    read = postings.read_index(spark, path, one)
    files = {r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    everything = {r.f for r in postings.read_index(spark, path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) <= 2 and len(everything) > 20 and [r.chunk_id for r in read.where("lexeme = 'word7'").collect()] == [7]
    rows = lambda: {(r.lexeme, r.chunk_id) for r in postings.read_index(spark, path).where("chunk_id < 3 OR chunk_id > 199").collect()}
    before = rows()
    postings.update_index(spark.createDataFrame([(1, "changed"), (300, "added")], "chunk_id long, content string"), spark.createDataFrame([(2,)], "chunk_id long"), path)
    after = {x for x in before if x[1] == 0} | {("chang", 1), ("ad", 300)}
    assert rows() == after
    # A generation without its commit doesn't count.
    (tmp_path / "terms" / "postings" / "generation=7").mkdir()
    assert rows() == after
    postings.compact(spark, path, str(tmp_path / "next"))
    path = str(tmp_path / "next")
    assert rows() == after


def test_contained_against_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c%_é") for _ in range(rng.randrange(12))) for _ in range(150)] + ["", None, "abc" * 500, "x\0y"]
    needles = [t[i : i + n] for t in texts if t for n in (1, 2, 3, 5) for i in (0, len(t) // 2)] + ["", None, "zzz", "zz", "z", "%", "_"]
    own = spark.createDataFrame([("f", t) for t in texts], "field string, text string")
    asked = spark.createDataFrame([("f", n) for n in needles], "field string, needle string")
    got = {(r.text, r.needle) for r in contain.contained(contain.gram_index(own), asked).collect()}
    fine = lambda t: t.replace("\0", " ")
    assert got == {(fine(t), fine(n)) for t in texts if t for n in needles if n and fine(n) in fine(t)}
    plan = contain.contained(contain.gram_index(own), asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_terms_are_joined_by_a_shuffle(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 5}") for i in range(60)], "chunk_id long, content string")
    index = postings.search_index(chunks, chunks.select(F.col("chunk_id").alias("document_id"), F.lit("t").alias("title"), F.lit("p").alias("path")))
    queries = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 5} delta epsilon") for i in range(50)], "query_id long, q string")
    want = sorted(map(tuple, search.text_channel(index, queries).collect()))
    monkeypatch.setattr(search, "MOST_TERMS", 10)
    assert sorted(map(tuple, search.text_channel(index, queries).collect())) == want
    monkeypatch.setattr(search, "MOST_QUERIES", 49)
    with pytest.raises(ValueError):
        search.text_channel(index, queries)


def test_stems(spark):
    from tessera.functions import english

    pairs = dict(p.split() for p in STEMS.split("|"))
    rows = english.with_lexemes(spark.createDataFrame([(t,) for t in [*pairs, "the", "", "v1.2", "x9s"]], "term string")).collect()
    assert {r.term: r.lexeme for r in rows} == pairs | {"v1.2": "v1.2", "x9s": "x9s"}


#: Words and stems as published with the algorithm, and its special cases.
STEMS = (
    "consign consign|consigned consign|consignment consign|consistency consist|consistently consist|consolation consol|consolatory consolatori|consolidating consolid|conspicuously conspicu|"
    "conspiracy conspiraci|conspirators conspir|constables constabl|constancy constanc|knackeries knackeri|knavish knavish|kneeled kneel|knightly knight|knitted knit|knives knive|knocker knocker|"
    "generate generat|general general|generous generous|hopping hop|hoping hope|falling fall|luxuriated luxuri|ties tie|cries cri|gas gas|gaps gap|cry cri|say say|relational relat|conditional condit|"
    "rational ration|agreed agre|activity activ|happily happili|skies sky|dying die|sensational sensat|biology biolog|hopefulness hope|electrical electr|adoption adopt|controlling control|roll roll|rate rate|"
    "cease ceas|proceeded proceed|innings inning|youth youth|boyish boyish|flying fli|bed bed|shed shed|ring ring|communication communic|arsenal arsenal|decisive decis|formality formal|used use|news news"
)


def test_change_sets(spark):
    old = spark.createDataFrame([("a", "n", 1), ("b", None, 2), ("c", "x", 3)], "id string, name string, v int")
    new = spark.createDataFrame([("a", "n", 1), ("b", "m", 2), ("d", None, 4)], "id string, name string, v int")
    changes = graph.changed_rows(old, new, ["id"])
    assert {(r.change, r.id) for r in changes.collect()} == {("update", "b"), ("delete", "c"), ("insert", "d")}
    once = graph.apply_changes(old, changes, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, new.collect())) == sorted(map(tuple, graph.apply_changes(once, changes, ["id"]).collect()))
    assert graph.changed_rows(new, new, ["id"]).count() == 0
    with pytest.raises(ValueError):
        graph.project_edges(spark.createDataFrame([("a", "b", "bad type")], "src string, dst string, type string"), new.select(F.col("id").alias("entity_id")))


def test_neighbourhood_counts(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(f"r{rng.randrange(90)}", f"t{rng.randrange(60)}", rng.choice(["USES", "OWNS"])) for _ in range(200)], "src string, dst string, type string")
    roots = spark.createDataFrame([(f"r{i}",) for i in range(90)] + [("alone",), ("r1",)], "entity_id string")
    for hops in (1, 2, 3):
        want = {(r.root, r.type): r["count"] for r in graph.neighbourhood(edges, roots, hops).groupBy("root", "type").count().collect()}
        assert {(r.root, r.type): r.n for r in graph.neighbourhood_counts(edges, roots, hops).collect()} == want


def test_resized_embeddings(spark):
    from tessera.operators import index

    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    assert [r.embedding for r in index.resize_embeddings(df, 2).collect()] == [[1.0, 2.0], None, None]


def test_vector_channel_answers_all_queries(spark, monkeypatch):
    from tessera.operators import search

    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "chunk_id long, vec array<double>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "query_id long, vec array<double>")
    got = search.vector_channel(base, asked, 3).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, n) for q in range(5) for n in (1, 2, 3)]
    assert search.vector_channel(base, asked.limit(0), 3).count() == 0


def test_similar_notes_beside_a_long_document(spark):
    from tessera.operators import search

    rows = [(i, 1, [1.0, i / 1e6]) for i in range(1500)] + [(2000 + i, 0, [1.0, 0.0]) for i in range(1500)] + [(5000 + d, d, [1.0, d / 10]) for d in range(2, 9)] + [(9000, 10, None), (9001, 11, [0.0, 0.0])]
    base = spark.createDataFrame(rows, "id long, document_id long, vec array<double>").repartition(3)
    got = search.similar_notes(base, [(0, [1.0, 0.0])], above=0.2).orderBy("rank").collect()
    assert [(r.document_id, r.rank) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and got[0].sim == 1.0


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400, 400 + i) for i in range(1, 90)] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7), (2000, 2000)]
    up = list(range(2100))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_long_texts_of_joined_parts(spark):
    from tessera.functions.text import rare_tokens, terms

    text = "a" + "-b1" * 100_000 + " x.y_z " + "1,2" * 50_000
    row = spark.createDataFrame([(text,)], "t string").select(terms(F.col("t")).alias("t"), rare_tokens(F.col("t")).alias("r")).first()
    assert row.t[0] == "a" + "-b1" * 100_000 and row.t[1] == "x.y_z" and any(r.startswith("a-b1") for r in row.r)


def test_nothing_is_cut_off(spark):
    assert len(search.parse_web_query(" OR ".join(f"a{i} b{i}" for i in range(5000)))) == 5000
    edges = spark.createDataFrame([(f"k{i:03d}", t, "USES") for t in ("a", "b") for i in range(40)], "src string, dst string, type string")
    known = spark.createDataFrame([(f"k{i:03d}", "Decision", "semantic", "n", None, None) for i in range(40)], "entity_id string, type string, kind string, name string, summary string, origin string")
    got = graph.attached_knowledge(edges, known, spark.createDataFrame([("a",), ("b",)], "entity_id string"), cap=30)
    assert {r.target: r["count"] for r in got.groupBy("target").count().collect()} == {"a": 30, "b": 30}


def test_free_paths_differ(spark):
    from tessera.operators import audit

    notes = spark.createDataFrame([(i, "agents", t) for i, t in enumerate(["view", "view", "view 2", "View", "view", "other", "view 2", "view-4"])], "note_id int, folder string, title string")
    got = {r.note_id: r.path for r in audit.free_paths(notes, spark.createDataFrame([("agents/other.md",), ("agents/other-2.md",), ("agents/view-5.md",)], "path string")).collect()}
    assert got == {0: "agents/view.md", 1: "agents/view-3.md", 2: "agents/view-2.md", 3: "agents/view-6.md", 4: "agents/view-7.md", 5: "agents/other-3.md", 6: "agents/view-2-2.md", 7: "agents/view-4.md"}


def test_neighbourhood_of_many_roots(spark):
    """Over 64 roots, hubs, loops, repeated edges and roots, against a search from each root alone."""
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(150)}", f"t{rng.randrange(400)}", "USES") for _ in range(300)] + [("r1", "r1", "USES"), ("r2", "t1", "OWNS"), ("r2", "t1", "OWNS"), (None, "r3", "USES")]
    rows += [(f"r{i}", "hub", "OWNS") for i in range(0, 150, 9)]
    names = [f"r{i}" for i in range(150)] + ["r5", None, "alone"]
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    roots = spark.createDataFrame([(n,) for n in names], "entity_id string")
    for hops in (1, 2, 3):
        want = {}
        for root in set(names) - {None}:
            far, now = {root: 0}, [root]
            for d in range(1, hops):
                now = [n for n in {y for s, t, _ in rows for x, y in ((s, t), (t, s)) if x in now and y is not None} if n not in far]
                far |= dict.fromkeys(now, d)
            want |= {(root, s, t, k): min(far.get(s, 9), far.get(t, 9)) for s, t, k in rows if s in far or t in far}
        got = graph.neighbourhood(edges, roots, hops).collect()
        assert len(got) == len(want) and {(r.root, r.src, r.dst, r.type): r.distance for r in got} == want


def test_cluster_order(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21), (2, 22), (3, 30), (3, 31), (4, 40), (4, 41)], "cluster long, id long")
    paths = {10: "b/x", 11: "a/x", 20: "a/x", 21: "b/y", 22: "b/z", 30: "a/q", 31: "a/r", 40: "projects/solution_designs/p", 41: "projects/other"}
    got = dedup.ordered_clusters(members, spark.createDataFrame(list(paths.items()), "id long, path string")).collect()
    assert [(r.cluster, r.folders, r.size) for r in got] == [(3, "a", 2), (2, "a ↔ b", 3), (1, "a ↔ b", 2), (4, "projects ↔ projects/solution_designs", 2)]


def test_consumers_knowledge(spark):
    edges = [("s", "t", "PUBLISHES_TO"), ("c", "t", "SUBSCRIBES_TO"), ("s", "t", "SUBSCRIBES_TO"), ("k1", "c", "USES"), ("s", "k2", "RELATES_TO"), ("k3", "other", "USES"), ("k4", "c", "MENTIONS")]
    known = [(k, "Decision", "semantic", k, None, None) for k in ("k1", "k2", "k3", "k4")]
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    k = spark.createDataFrame(known, "entity_id string, type string, kind string, name string, summary string, origin string")
    roots = spark.createDataFrame([("s",), ("alone",)], "entity_id string")
    assert {(r.root, r.source, r.name) for r in graph.impact_knowledge(e, k, roots).collect()} == {("s", "s", "k2"), ("s", "c", "k1")}
    assert [r.name for r in graph.impact_knowledge(e, k, roots, cap=1).collect()] == ["k2"]  # its own comes first
    assert [(r.topic, r.consumers, r.n_consumers) for r in graph.publishes(e, roots).collect()] == [("t", "c", 1)]


def test_neighbourhood_counts_by_degrees(spark, monkeypatch):
    """Odd cycles, loops, null ends, several types and over 512 roots; no plan brings a row for each edge and block to an exchange."""
    rng = random.Random(12)
    rows = [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}", rng.choice(["USES", "OWNS"])) for _ in range(70)]
    rows += [("r1", "r1", "USES"), ("r9", "r9", "OWNS"), (None, "r3", "USES"), ("r4", None, "OWNS"), *[(f"q{i}", f"q{(i + 1) % 5}", "USES") for i in range(5)], *[(f"x{i}", "hub", "OWNS") for i in range(700)]]
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    roots = spark.createDataFrame([(f"{k}{i}",) for k, n in (("r", 40), ("q", 5), ("x", 700)) for i in range(n)] + [(None,), ("alone",)], "entity_id string")
    made = graph.stage
    sizes = []
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": sizes.append((name, df.columns)) or made(df, name))
    for hops in (1, 2, 3):
        want = {}
        for root in {r.entity_id for r in roots.collect()} - {None}:
            near, now = {root}, {root}
            for _ in range(1, hops):
                now = {y for s, t, _ in rows for x, y in ((s, t), (t, s)) if x in now and y is not None} - near
                near |= now
            for s, t, k in set(rows):
                if s in near or t in near:
                    want[root, k] = want.get((root, k), 0) + 1
        got = graph.neighbourhood_counts(edges, roots, hops)
        assert {(r.root, r.type): r.n for r in got.collect()} == want
    # Blocks are kept for nodes alone, 512 roots a row.
    assert all(set(c) == {"node", "block", *[f"m{w}" for w in range(8)]} for name, c in sizes if name == "frontier")


def test_first_knowledge_of_many_consumers(spark, monkeypatch):
    """Caps against all rows, with roots that subscribe to their own topics; what is out of bounds doesn't reach the roots."""
    rng = random.Random(3)
    pubs = {(f"s{rng.randrange(12)}", f"t{rng.randrange(60)}") for _ in range(300)} | {("s12", "t1")}
    subs = {(f"c{rng.randrange(80)}", f"t{rng.randrange(60)}") for _ in range(500)} | {(f"s{i}", f"t{rng.randrange(60)}") for i in range(12) for _ in range(9)}
    uses = {(f"k{rng.randrange(900):03d}", rng.choice([f"c{rng.randrange(80)}", f"s{rng.randrange(13)}"])) for _ in range(1500)}
    edges = spark.createDataFrame([(s, t, "PUBLISHES_TO") for s, t in pubs] + [(c, t, "SUBSCRIBES_TO") for c, t in subs] + [(k, c, "USES") for k, c in uses], "src string, dst string, type string")
    known = spark.createDataFrame([(f"k{i:03d}", "Decision", "semantic", "n", None, None) for i in range(900)], "entity_id string, type string, kind string, name string, summary string, origin string")
    roots = spark.createDataFrame([(f"s{i}",) for i in range(13)], "entity_id string")
    made, sizes = graph.stage, {}
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": sizes.setdefault(name, made(df, name)))
    want = {}
    for r in {f"s{i}" for i in range(13)}:
        near = {(0, k, r) for k, c in uses if c == r}
        far = {c for s, t in pubs if s == r for c, u in subs if u == t and c != r}
        want[r] = sorted(near | {(1, k, c) for k, c in uses if c in far})
    for cap in (1, 5, 30, None):
        sizes.clear()
        got = graph.impact_knowledge(edges, known, roots, cap).select("root", "source", "entity_id").collect()
        assert sorted(map(tuple, got)) == sorted((r, c, k) for r, rows in want.items() for _, k, c in rows[:cap])
        if cap == 5:
            assert sizes["bounds"].where("bound IS NOT NULL").count() > 200 and "targets" not in sizes


def test_candidates_of_text_searches(spark, monkeypatch):
    """First k of each query among many ties, as by the way without candidates; few rows leave a task where many chunks share a word."""
    rng = random.Random(6)
    words = [f"w{i}a" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(900)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    index = postings.search_index(chunks, chunks.select(F.col("chunk_id").alias("document_id"), F.lit("t").alias("title"), F.lit("p").alias("path")))
    asked = [(i, " ".join(rng.sample(words, 3))) for i in range(20)] + [(50, '"w1a w2a"'), (51, "w1a OR w2a -w3a"), (52, "w1a nothing"), (53, "w4a"), (54, "-w5a"), (55, '"w1a w2a w3a w4a w5a w6a"')]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    monkeypatch.setattr(search, "WEIGHED", 16)
    made, seen = search._candidates, []
    monkeypatch.setattr(search, "_candidates", lambda *a: seen.append(made(*a)) or seen[-1])
    got = sorted(map(tuple, search.text_channel(index, queries, 5).collect()))
    assert seen[0].where("query_id IN (52, 54)").count() <= 2 * 5 * 4 and seen[0].where("query_id = 53 AND found IS NULL").count() == 0
    monkeypatch.setattr(search, "MOST_TERMS", 3)
    assert got == sorted(map(tuple, search.text_channel(index, queries, 5).collect())) and len(seen) == 1 and len(got) > 110


def test_components_carry_an_edge_once(spark):
    sizes = []
    made = graph.stage
    pairs = [(i, i + 1) for i in range(50)] + [(9, 3), (60, 61), (5, 5)]
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"), lambda df: sizes.append(made(df)) or sizes[-1])
    assert sizes[0].count() == 52 and {r.node: r.comp for r in got.collect()} == {**dict.fromkeys(range(51), 0), 60: 60, 61: 60}


def test_a_search_makes_the_parts_it_reads(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 0, "built with v1.2.3 here"), (2, 2, 0, "nothing")], "chunk_id long, document_id long, chunk_index int, content string")
    docs = chunks.select("document_id", F.lit("t").alias("title"), F.lit("p").alias("path"))
    index = postings.search_index(chunks, docs)
    got = search.exact_channel(index, chunks, spark.createDataFrame([(7, "about v1.2.3")], "query_id long, q string")).collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(7, 1)] and "terms" not in vars(index)
    assert postings.read_index(spark, index.terms).where("lexeme = 'noth'").count() == 1
    whole = postings.search_index(chunks, docs, str(tmp_path / "index"))
    assert {"terms", "names", "runs", "grams"} <= set(vars(whole))


def test_edges_are_made_distinct_by_numbers(spark, sf):
    from tessera.sources import catalog

    plan = catalog.edges(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert len(keys) == 2 and all("partkey" in line and "src" not in line for line in keys)


def test_terms_of_few_chunks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(postings, "TOGETHER", 2)
    chunks = spark.createDataFrame([(i, f"red{i} well-known red{i}") for i in range(5)], "chunk_id long, content string").coalesce(1)
    got = {(r.chunk_id, r.term): r.positions for r in postings.spoken(chunks).collect()}
    assert got == {k: v for i in range(5) for k, v in {(i, f"red{i}"): [0, 4], (i, "well-known"): [1], (i, "well"): [2], (i, "known"): [3]}.items()}


def test_neighbourhood_counts_with_hubs(spark, monkeypatch):
    """What hubs reach is counted by class: against a search from each root, with hubs among the roots, loops at hubs, hubs beside hubs, null ends; no rows for a hub's blocks times its neighbours."""
    monkeypatch.setattr(graph, "HUB", 20)
    monkeypatch.setattr(graph, "OPENED", 16)
    made, sizes = graph.stage, {}
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": sizes.setdefault(name, []).append(made(df, name)) or sizes[name][-1])
    rng = random.Random(21)
    kinds = ["USES", "OWNS"]
    rows = [(f"x{i}", f"h{rng.randrange(4)}", rng.choice(kinds)) for i in range(1200) if i % 5] + [(f"h{rng.randrange(4)}", f"x{i}", "OWNS") for i in range(0, 1200, 3)]
    rows += [(f"x{rng.randrange(1200)}", f"x{rng.randrange(1200)}", rng.choice(kinds)) for _ in range(700)] + [(f"x{i}", f"y{rng.randrange(90)}", "USES") for i in range(0, 1200, 2)]
    rows += [("h1", "h2", "USES"), ("h0", "h0", "OWNS"), ("x7", "x7", "USES"), ("x7", "x7", "USES"), ("h3", "h0", "USES"), (None, "h1", "USES"), ("x3", None, "OWNS"), (None, "x3", "OWNS"), (None, None, "USES"), ("y1", "h2", "OWNS")]
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    names = [f"x{i}" for i in range(1200)] + ["h0", "h1", "h3", "y1", "alone", None]
    beside = {}
    for s, t, _ in rows:
        for x, y in ((s, t), (t, s)):
            if x is not None:
                beside.setdefault(x, set()).add(y)
    every = set(rows)
    at = {}
    for e in every:
        for x in e[:2]:
            at.setdefault(x, set()).add(e)
    want = {}
    for root in set(names) - {None}:
        near = {root}
        for _ in range(2):
            near |= {y for x in near for y in beside.get(x, ()) if y is not None}
        for e in set().union(*(at.get(x, set()) for x in near)):
            want[root, e[2]] = want.get((root, e[2]), 0) + 1
    roots = spark.createDataFrame([(n,) for n in names], "entity_id string")
    for most in (256, 2):
        sizes.clear()
        monkeypatch.setattr(graph, "MOST_HUBS", most)
        got = graph.neighbourhood_counts(edges, roots, 3).collect()
        assert len(got) == len(want) and {(r.root, r.type): r.n for r in got} == want
        assert sizes["hubs"][0].count() >= 2
    monkeypatch.setattr(graph, "MOST_HUBS", 256)
    star = spark.createDataFrame([(f"x{i}", "hub", "USES") for i in range(3000)], "src string, dst string, type string")
    sizes.clear()
    got = graph.neighbourhood_counts(star, star.select(F.col("src").alias("entity_id")), 3).collect()
    assert {r.root: r.n for r in got} == dict.fromkeys((f"x{i}" for i in range(3000)), 3000)
    # 3,000 nodes in 6 blocks of roots or more: a row each is for themselves, not for all blocks.
    assert sum(t.count() for t in sizes["far"]) <= 2 * 3100


def test_edges_by_numbers(spark, sf):
    """The numbers of the edges' ends stand for the same edges as the texts."""
    from tessera.sources import catalog

    text = lambda c: F.concat(F.element_at(F.array(*[F.lit(k) for k in catalog.LETTERS]), F.pmod(c, F.lit(8)).cast("int") + 1), F.shiftright(c, 3).cast("string")).alias(c)
    got = catalog.edge_numbers(spark, sf).distinct().select(text("src"), text("dst"), "type")
    want = catalog.edges(spark, sf)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_neighbourhood_counts_without_odd_cycles(spark, monkeypatch):
    """Roots, topics and contexts: no edge is looked at for equally far ends, and contexts with many members give no row for a member and each block of roots."""
    monkeypatch.setattr(graph, "HUB", 100)
    made, sizes = graph.stage, {}
    monkeypatch.setattr(graph, "stage", lambda df, name="stage": sizes.setdefault(name, []).append(made(df, name)) or sizes[name][-1])
    rows = [(f"s{i}", f"n{i % 3}", "BELONGS_TO") for i in range(2400)] + [(f"n{i}", "r0", "BELONGS_TO") for i in range(3)] + [(f"s{i}", f"p{j}", "PUBLISHES_TO") for i in range(2400) for j in (i // 8, i // 8 + 1)]
    edges = spark.createDataFrame(rows + [("c1", "p1", "SUBSCRIBES_TO")], "src string, dst string, type string")
    got = graph.neighbourhood_counts(edges, spark.createDataFrame([(f"s{i}",) for i in range(2400)], "entity_id string"), 3, ["PUBLISHES_TO", "BELONGS_TO"]).collect()
    near = {}
    for i in range(2400):
        # Its context's 800 members and the members that share a topic (their groups of 8 are neighbours), each with an edge to a context and two to topics.
        near[i] = {*range(i % 3, 2400, 3), *(j for j in range(max(0, (i // 8 - 1) * 8), min(2400, (i // 8 + 2) * 8)))}
    want = {}
    for i, members in near.items():
        want[f"s{i}", "BELONGS_TO"], want[f"s{i}", "PUBLISHES_TO"] = len(members) + 3, 2 * len(members)
    assert {(r.root, r.type): r.n for r in got} == want
    # 5 blocks or more: without classes there are 2,400 rows for each, 12,000 at least.
    assert sizes["flat"][0].count() == 0 and sizes["far"][0].count() < 2 * 2400 * 2
