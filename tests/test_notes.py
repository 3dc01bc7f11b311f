from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import index, notes
from tessera.sources import vault

NOTES = {
    "technologies/a/svc-a.md": '---\ntitle: Service A\ntags: [x, y]\nuses: ["[[Postgres]]", "svc-b"]\ncreated_by: bot\n---\nText about [[Postgres]].\n',
    "decisions/d1.md": "# D1\nSee [[Target|alias]], [[Target#part]], [[D1]] and [[Other]].\n",
    "notes/plain.md": "nothing here\n",
    "projects/typed.md": "---\ntype: decision\ntags: single\n---\nbody\n",
    "projects/correction.md": "# One\nfirst\n\n## Correction: of one\nsecond\n\n## Three\nthird\n",
    ".obsidian/x.md": "hidden",
    "a.txt": "no note",
    "node_modules/m.md": "skipped",
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in NOTES.items():
        p = Path(root, name)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = notes.parse_notes(vault.with_frontmatter(vault.read_vault(spark, str(root))))
    return {r.path: r for r in rows.collect()}


def test_vault_scan_and_parse(parsed):
    assert sorted(parsed) == ["decisions/d1.md", "notes/plain.md", "projects/correction.md", "projects/typed.md", "technologies/a/svc-a.md"]
    a, d, p, t = (parsed[k] for k in ("technologies/a/svc-a.md", "decisions/d1.md", "notes/plain.md", "projects/typed.md"))
    assert (a.title, a.type, a.tags) == ("Service A", "Technology", ["x", "y"])
    assert [(x.type, x.target) for x in a.links] == [("MENTIONS", "Postgres"), ("USES", "Postgres"), ("USES", "svc-b"), ("CREATED_BY", "bot")]
    assert (d.title, d.type) == ("D1", "Decision")
    assert [x.target for x in d.links] == ["Target", "Other"]
    assert (p.title, p.type, p.links, p.tags) == ("plain", "Note", [], [])
    assert (t.type, t.tags) == ("Decision", ["single"])


def test_correction_supersedes_earlier_sections(spark, parsed):
    body = parsed["projects/correction.md"].body
    assert [s for _, s in notes.chunk_text(body)] == [True, False, False]
    df = spark.createDataFrame([(1, body)], "id int, body string")
    assert [r.superseded for r in notes.sections(df, "id", "body").orderBy("section").collect()] == [True, False, False]
    assert [r.superseded for r in notes.chunk_documents(df, "id").orderBy("chunk_index").collect()] == [True, False, False]


def test_chunk_packing():
    body = "\n\n".join(["a" * 700, "b" * 700, "c" * 200, "d" * 4000, "word " * 600])
    sizes = [len(c) for c, _ in notes.chunk_text(body)]
    assert sizes[0] == 1402 and sizes[1] == 200 and sizes[2:5] == [1500, 1500, 1000]
    assert max(sizes) <= 1500
    assert notes.chunk_text("") == [] and notes.chunk_text(None) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=400))
def test_chunks_keep_every_character(body):
    got = notes.chunk_text(body, 40)
    assert all(0 < len(c) <= 40 for c, _ in got)
    assert "".join("".join(c.split()) for c, _ in got) == "".join(body.split())


def test_incremental_state(spark):
    schema = "path string, content_hash string"
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], schema)
    state = spark.createDataFrame([("a", "1"), ("b", "old"), ("z", "9")], "path string, last_hash string")
    assert sorted(r.path for r in index.changed(now, state).collect()) == ["b", "c"]
    assert [r.path for r in index.removed(state, now).collect()] == ["z"]
    done = now.withColumnRenamed("content_hash", "last_hash")
    assert index.changed(now, done).count() == 0


def test_adopt_and_sync(spark):
    ent = "entity_id string, type string, name string, document_id string, metadata string"
    entities = spark.createDataFrame([("e1", "Note", "A", "d1", "{}"), ("e2", "Note", "B", None, '{"placeholder": true}'), ("e3", "Topic", "T", None, "{}")], ent)
    fresh = spark.createDataFrame([("d1", "Decision", "A2", "{}"), ("d2", "Project", "B", "{}"), ("d3", "Idea", "C", "{}")], "document_id string, type string, name string, metadata string")
    got = {r.document_id: r for r in index.adopt_entities(entities, fresh).collect()}
    assert (got["d1"].entity_id, got["d1"].name) == ("e1", "A2") and got["d2"].entity_id == "e2" and got["d3"].entity_id not in ("e1", "e2", "e3")
    rel = "source_entity_id string, target_entity_id string, relation_type string, confidence float, origin_document_id string"
    relations = spark.createDataFrame([("e1", "e3", "USES", 1.0, None), ("e1", "e3", "SUPPORTS", 0.5, "d9"), ("e3", "e1", "USES", 1.0, None)], rel)
    links = spark.createDataFrame([("e1", "MENTIONS", "B"), ("e1", "MENTIONS", "B"), ("e1", "USES", "nobody"), ("e1", "MENTIONS", "A")], "source_entity_id string, relation_type string, target string")
    rels, ents = index.sync_relations(relations, entities, links, spark.createDataFrame([("e1",)], "entity_id string"))
    kept = {(r.source_entity_id, r.relation_type, r.origin_document_id) for r in rels.collect()}
    assert kept == {("e1", "SUPPORTS", "d9"), ("e3", "USES", None), ("e1", "MENTIONS", None), ("e1", "USES", None)}
    assert ents.where("name = 'nobody' AND type = 'Note'").count() == 1 and ents.count() == 4


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", "1", "t0"), ("b", "2", "t0")], "path string, v string, created string")
    new = spark.createDataFrame([("b", "3", "t1"), ("c", "4", "t1")], "path string, v string, created string")
    assert sorted(map(tuple, index.upsert(old, new, ["path"], ["created"]).collect())) == [("a", "1", "t0"), ("b", "3", "t0"), ("c", "4", "t1")]
    docs = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    chunks = spark.createDataFrame([("d1", 0), ("d2", 0)], "document_id string, chunk_index int")
    ents = spark.createDataFrame([("e1", "d1"), ("e2", "d2")], "entity_id string, document_id string")
    rels = spark.createDataFrame([("e1", "e2", None), ("e2", "e1", None), ("e2", "e2", "d1"), ("e2", "x", None)], "source_entity_id string, target_entity_id string, origin_document_id string")
    out = index.delete_documents(docs.where("document_id = 'd1'"), docs, chunks, ents, rels)
    assert {k: v.count() for k, v in out.items()} == {"documents": 1, "chunks": 1, "entities": 1, "relations": 1}


def test_request_log(spark):
    lines = ['{"time": 1700000000000, "msg": "incoming request", "req": {"url": "/search?q=x", "method": "GET"}}', '{"msg":"incoming request"', '{"time": 1, "msg": "incoming request", "req": {"url": "/nowhere", "method": "GET"}}', "{}"]
    rows = vault.request_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.endpoint, r.method, r.ts.year) for r in rows] == [("/search", "GET", 2023)]
