from datetime import datetime

import pytest

from tessera.api import Knowledge
from tessera.operators import lookup

T = datetime(2024, 1, 30)


@pytest.fixture(scope="module")
def base(spark):
    documents = spark.createDataFrame(
        [
            (1, "technologies/kafka.md", "Kafka", "Kafka topics and order-events in depth", None, None, None, T, T),
            (2, "archive/old.md", "Old Kafka", "kafka topics once", "decision", None, "d1", T, T),
            (3, "agents/bot/p.md", "Proposal", "use order-events 4.5%", "task", "proposed", None, T, T),
        ],
        "document_id long, path string, title string, content string, kind string, status string, superseded_by string, created_at timestamp, updated_at timestamp",
    )
    chunks = spark.createDataFrame([(10, 1, 0, "Kafka topics and order-events in depth", True), (11, 1, 1, "Corrected: kafka has topics", False), (20, 2, 0, "kafka topics once", False), (30, 3, 0, "use order-events 4.5%", False)], "chunk_id long, document_id long, chunk_index int, content string, superseded boolean")
    entities = spark.createDataFrame([("a", "Service", "order-service", 1, None, None, None, ["agents/bot/p.md"]), ("t", "Topic", "order-events", None, None, None, None, []), ("b", "Service", "bill-service", 3, None, None, None, []), ("k", "Decision", "Keep it", None, "semantic", "s", "human", [])], "entity_id string, type string, name string, document_id long, kind string, summary string, origin string, sources array<string>")
    relations = spark.createDataFrame([("a", "t", "PUBLISHES_TO", 1.0), ("b", "t", "SUBSCRIBES_TO", 1.0), ("k", "a", "RELATES_TO", 0.5)], "src string, dst string, type string, confidence float")
    events = spark.createDataFrame([(T, "/search", "GET", 200, 5, "bot"), (T, "/link", "POST", 500, None, None)], "ts timestamp, endpoint string, method string, status int, duration_ms int, agent string")
    return Knowledge(documents, chunks, entities, relations, events=events)


def test_search_and_context(spark, base):
    q = spark.createDataFrame([(1, "kafka topics"), (2, "order-events 4.5%"), (3, "zzz")], "query_id long, q string")
    rows = base.search(q).collect()
    by = {(r.query_id, r.position): r for r in rows}
    assert by[1, 1].document_id == 1 and by[1, 1].superseded is False and by[2, 1].document_id == 3
    assert len({(r.query_id, r.document_id) for r in rows}) == len(rows) and not [r for r in rows if r.query_id == 3]
    described = {r.document_id: r for r in base.search(q, agent="bot", as_of="2024-01-31").collect()}
    assert described[3].kind == "task" and described[1].entity_type == "Service" and described[1].tags == [] and described[1].own_recent is False and described[3].content == "use order-events 4.5%"
    assert rows and sorted((r.query_id, r.document_id) for r in base.indexed().search(q).collect()) == sorted((r.query_id, r.document_id) for r in rows)
    context = {r.document_id: r.markdown for r in base.context(q).collect()}
    assert "- PUBLISHES_TO -> order-events" in context[1] and "- RELATES_TO <- Keep it" in context[1]


def test_graph_and_impact(spark, base):
    asked = spark.createDataFrame([("service",), ("order/service",)], "q string")
    edges = {(r.root, r.src, r.dst) for r in base.graph(asked, 2).collect()}
    assert ("a", "b", "t") in edges and ("a", "k", "a") in edges
    impact = {k: v.collect() for k, v in base.impact(spark.createDataFrame([("order-service",)], "q string")).items()}
    assert [(r.topic, r.consumers) for r in impact["publishes"]] == [("t", "b")]
    assert [(r.name, r.source) for r in impact["attached_knowledge"]] == [("Keep it", "a")]
    assert [(r.updated_at, r.analysis_commit) for r in impact["freshness"]] == [(T, None)]


def test_notes_and_writes(spark, base):
    found = {r.q: (r.document_id, r.how) for r in base.note(spark.createDataFrame([("archive/OLD.md",), ("proposal",), ("bill-service",), ("nothing",)], "q string")).collect()}
    assert found == {"archive/OLD.md": (2, 1), "proposal": (3, 3), "bill-service": (3, 5)}
    ok, bad = base.remember(spark.createDataFrame([(1, "agents/bot", "P", "idea", "text"), (2, "agents/bot", "Q", "nope", "text")], "note_id int, folder string, title string, kind string, content string"))
    assert [r.path for r in ok.collect()] == ["agents/bot/p-2.md"] and [r.problem for r in bad.collect()] == ["kind"]
    assert [r.path for r in base.proposals().collect()] == ["agents/bot/p.md"]
    moved = base.promote("agents/bot/p.md", "notes/p.md")
    assert moved.entities.where("entity_id = 'a'").first().origin == "human" and moved.documents.where("path = 'notes/p.md'").count() == 1
    linked = base.link(spark.createDataFrame([("order-service", "bill-service", "calls_http", 0.7), ("order-service", "order-events", "publishes_to", 0.2), ("x y z", "order-events", "uses", 1.0)], "source string, target string, type string, confidence double"))
    got = {(r.src, r.dst, r.type): round(r.confidence, 3) for r in linked.relations.collect()}
    assert got[("a", "b", "CALLS_HTTP")] == 0.7 and got[("a", "t", "PUBLISHES_TO")] == 0.2 and len(got) == 4
    with pytest.raises(ValueError):
        base.link(spark.createDataFrame([("a", "b", "bad type", 1.0)], "source string, target string, type string, confidence double"))
    assert base.stats("2024-01-31")["totals"].first().calls == 2 and base.changes("2024-01-31").count() == 3


def test_lookup_and_reports(spark, base):
    assert [r.name for r in base.entity_by_name("SERVICE").collect()] == ["bill-service", "order-service"]
    rows = base.entity(spark.createDataFrame([("a",), ("k",)], "entity_id string")).collect()
    assert {(r.entity_id, r.direction, r.other) for r in rows} == {("a", "out", "t"), ("a", "in", "k"), ("k", "out", "a")}
    checks = spark.createDataFrame([(1, "kafka", None), (2, "kafka", 1)], "query_id long, expect_path string, top_n int")
    results = spark.createDataFrame([(1, "technologies/kafka.md", 3), (2, "x.md", 1), (2, "kafka.md", 2)], "query_id long, path string, position int")
    assert {r.query_id: r.passed for r in lookup.golden_results(checks, results).collect()} == {1: True, 2: False}
    moc = lookup.map_of_content(spark.createDataFrame([("g", "b"), ("g", "a")], "g string, n string"), "g", "n").first()
    assert moc.markdown == "## g\n- [[a]]\n- [[b]]"
    assert lookup.impact_markdown({"name": "x", "type": "Service"}) is None
    text = lookup.impact_markdown({"name": "x", "type": "Service", "publishes": {"t": ["b", "a"]}, "belongs_to": ["c"], "knowledge": [("Decision", "D", None, "x")]})
    assert "read by a, b" in text and "Part of c." in text and "- Decision **D** (x)" in text
