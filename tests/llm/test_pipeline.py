import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import queries


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(queries.QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "got"))
    con.execute(f"CREATE TABLE want AS SELECT * FROM ({queries.ORACLE_SQL[name]})")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    cols = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE want").fetchall()))
    for one, two in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT {cols} FROM {one} EXCEPT ALL SELECT {cols} FROM {two}").fetchall() == []


def test_stages(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, sf)
        assert after.columns == docs.columns, name
        assert after.join(before, docs.columns, "left_anti").count() == 0
        before = after
    kept = {r.doc_id for r in before.collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == kept
    odd_kept = odd
    for _, step in corpus_pipeline.STAGES[:-1]:
        odd_kept = step(spark, odd_kept, sf)
    ids = sorted(r.doc_id for r in odd_kept.collect() if r.doc_id is not None)  # rows without an identifier pass
    assert ids == [3, 5, 8]
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, odd.limit(0), sf).count() == 0


def test_copies_by_row(spark, make, sf):
    stay = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, make(rows), sf).collect()), key=str)
    assert stay([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, None)]) == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, None)], key=str)
    assert stay([(1, "same"), (4, "same"), (4, "other")]) == [(1, "same"), (4, "other")]
    assert len(stay([(4, "Alpha"), (4, "alpha"), (5, "ALPHA")])) == 1
    assert stay([(4, "x"), (4, "x"), (4, "x"), (None, "x"), (None, "x")]) == [(None, "x")]


def test_near_copies_by_row(spark, make, sf):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:30] + ["other"] + words[31:])
    rows = [(3, " ".join(words)), (3, near), (2, " ".join([*words, "end"])), (None, " ".join(["start", *words])), (2, "something else entirely"), (7, "twice told tale"), (7, "twice told tale"), (8, None), (None, "")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, make(rows), sf).collect()), key=str)
    assert got == sorted([(2, rows[2][1]), (2, rows[4][1]), (7, "twice told tale"), (8, None), (None, "")], key=str)


def test_leaks_by_row(spark, make, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").first().text
    got = corpus_pipeline.drop_leaks(spark, make([(1, item), (1, "clean"), (None, "see " + item.lower()), (None, "fine"), (2, None)]), sf).collect()
    assert sorted((r.text or "") for r in got) == ["", "clean", "fine"]
