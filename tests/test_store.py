"""Extractions stored in one commit, against the same steps one document at a time."""

import random

import pytest

from tessera.operators import extract, store
from tessera.sources.tables import Conflict, Tables


@pytest.fixture
def tables(spark, tmp_path):
    out = Tables(spark, f"file://{tmp_path}/t")
    e = [("n1", "Note", "Doc One", "1", "note", None, None, None, None), ("n2", "Note", "Doc Two", "2", "note", None, None, None, None),
         ("k", "Service", "kafka", None, "semantic", "old", 0.5, ["notes/z.md"], "human"), ("gone", "Service", "lonely", None, "semantic", "x", 0.5, ["agents/a.md"], "agent")]
    r = [("k", "n1", "USES", 1.0, None), ("gone", "k", "USES", 1.0, "1"), ("n1", "n2", "MENTIONS", 1.0, "9")]
    out.commit({"entities": spark.createDataFrame(e, store.ENTITIES), "relations": spark.createDataFrame(r, store.RELATIONS), "extraction_state": spark.createDataFrame([("1", "h0", "m0", "t0")], store.STATE)})
    return out


def batch(spark, rows):
    """rows: (document_id, path, title, objects (name, type), relations (source, target))."""
    docs = spark.createDataFrame([(i, p, t, f"h{i}") for i, p, t, *_ in rows], "document_id string, path string, title string, content_hash string")
    got = [(i, [(k, n, f"{n} of {i}", 0.9) for n, k in o], [(s, t, "USES", 0.8) for s, t in r]) for i, _, _, o, r in rows]
    return docs, spark.createDataFrame(got, f"document_id string, {extract.EXTRACTION}")


def test_a_batch(spark, tables):
    docs, got = batch(spark, [("1", "agents/a.md", "Doc One", [("Kafka", "Topic"), ("order/svc", "Service")], [("kafka", "doc one"), ("kafka", "nobody"), ("Kafka", "KAFKA")]),
                              ("2", "notes/b.md", "Doc Two", [("order-svc", "Topic"), ("big-order-svc", "Service"), ("Doc Two", "Service")], [("order-svc", "doc two"), ("big-order-svc", "Doc Two")])])
    assert store.store_extraction(tables, docs, got, "m", "t") == 2
    e = {r.entity_id: r for r in tables.read("entities").collect()}
    new = next(r for r in e.values() if r.name == "order/svc")
    assert set(e) == {"n1", "n2", "k", new.entity_id}  # "gone" lost its only edge
    assert (e["k"].type, e["k"].name, e["k"].summary, e["k"].sources, e["k"].origin) == ("Topic", "kafka", "Kafka of 1", ["notes/z.md", "agents/a.md"], "human")
    assert (new.type, new.summary, new.sources, new.origin) == ("Service", "big-order-svc of 2", ["agents/a.md", "notes/b.md"], "human")
    assert e["n2"].type == "Note"  # a note isn't relabelled
    edges = {(r.source_entity_id, r.target_entity_id, r.relation_type): r.origin_document_id for r in tables.read("relations").collect()}
    assert edges == {("k", "n1", "USES"): None, ("n1", "n2", "MENTIONS"): "9", ("k", "n1", "EXTRACTED_FROM"): "1", (new.entity_id, "n1", "EXTRACTED_FROM"): "1", (new.entity_id, "n2", "EXTRACTED_FROM"): "2", (new.entity_id, "n2", "USES"): "2"}
    assert {(r.document_id, r.last_hash, r.model) for r in tables.read("extraction_state").collect()} == {("1", "h1", "m"), ("2", "h2", "m")}
    store.store_extraction(tables, docs, got, "m", "t")  # the same again changes nothing
    assert sorted(tables.read("relations").collect(), key=str) == sorted(tables.read("relations", 2).collect(), key=str)
    assert {r.entity_id for r in tables.read("entities").collect()} == set(e)


def test_failure_midway_leaves_the_old_state(spark, tables):
    from pyspark.sql import functions as F

    before = {n: sorted(map(str, tables.read(n).collect())) for n in tables.names()}
    bad = tables.read("relations").withColumn("confidence", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"entities": tables.read("entities").limit(0), "relations": bad})
    assert tables.version() == 1 and before == {n: sorted(map(str, tables.read(n).collect())) for n in tables.names()}


def test_two_writers(spark, tables):
    old = tables.read("entities")
    assert tables.commit({"entities": old.limit(1)}, base=1) == 2
    with pytest.raises(Conflict):
        tables.commit({"entities": old}, base=1)
    with pytest.raises(Conflict):
        tables._publish(2, "{}")
    assert tables.read("entities").count() == 1 and tables.read("entities", 1).count() == 4 == old.count()
    assert tables.names() == ["entities", "extraction_state", "relations"]


def test_empty_and_null(spark, tables):
    docs, got = batch(spark, [("1", "a.md", None, [(None, "Service"), ("x", None)], [(None, "x"), ("x", None)]), ("7", "b.md", "t", [], [])])
    store.store_extraction(tables, docs, got, "m", "t")
    assert "x" not in {r.name for r in tables.read("entities").collect()}
    store.store_extraction(tables, docs.limit(0), got.limit(0), "m", "t")
    assert tables.version() == 3 and tables.read("extraction_state").count() == 2


def test_edges_against_one_document_at_a_time(spark, tables):
    rng = random.Random(3)
    rows = [(str(i), f"notes/{i:02d}.md", f"Title {i}", [(f"thing{rng.randrange(12)}", "Service") for _ in range(4)], [(f"thing{rng.randrange(12)}", rng.choice(["title %d" % i, f"thing{rng.randrange(12)}"])) for _ in range(6)]) for i in range(20)]
    store.store_extraction(tables, *batch(spark, rows), "m", "t")
    name = {r.entity_id: r.name.lower() for r in tables.read("entities").collect()}
    note = {"1": "doc one", "2": "doc two"}
    want = {}
    for i, _, title, objects, links in rows:
        known = {title.lower(): note[i]} if i in note else {}
        for n, _ in objects:
            known[n] = n
            if i in note:
                want.setdefault((n, note[i], "EXTRACTED_FROM"), i)
        for s, t in links:
            if s in known and t in known and known[s] != known[t]:
                want.setdefault((known[s], known[t], "USES"), i)
    got = {(name[r.source_entity_id], name[r.target_entity_id], r.relation_type): r.origin_document_id for r in tables.read("relations").where("origin_document_id IS NOT NULL AND origin_document_id != '9'").collect()}
    assert got == want
