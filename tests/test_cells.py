"""Exact similarity join and vector index, against brute force."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cells

FAR = 0.85


def grouped(seed: int, groups: int, each: int, dims: int, spread: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dims))
    return np.concatenate([c + spread * rng.standard_normal((each, dims)) for c in centre])


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")


def unit(v):
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("above", [-0.2, 0.5, 0.85, 0.999])
@pytest.mark.parametrize("kind", ["groups", "noise", "copies"])
def test_similar_pairs_are_all_pairs(spark, above, kind):
    v = {"groups": grouped(1, 8, 12, 6, 0.3), "noise": np.random.default_rng(2).standard_normal((90, 5)), "copies": np.repeat(grouped(3, 5, 6, 4, 0.4), 3, axis=0)}[kind]
    sim = unit(v) @ unit(v).T
    want = {(i, j): sim[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if sim[i, j] > above}
    rows = cells.similar_pairs(frame(spark, v), above, blocks=7).collect()
    edge = {p for p, s in want.items() if abs(s - above) < 1e-9}
    assert len(rows) == len({(r.a, r.b) for r in rows}) and {(r.a, r.b) for r in rows} - edge == set(want) - edge
    assert all(math.isclose(r.sim, want[r.a, r.b], abs_tol=1e-9) for r in rows)


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    """A cell with most rows and many guests is cut, and no pair is lost or doubled."""
    monkeypatch.setattr(cells, "BLOCK", 10)
    v = np.concatenate([grouped(4, 1, 60, 5, 0.2), grouped(5, 6, 10, 5, 0.6)])
    sim = unit(v) @ unit(v).T
    rows = cells.similar_pairs(frame(spark, v), 0.6, blocks=5).collect()
    assert sorted((r.a, r.b) for r in rows) == [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if sim[i, j] > 0.6]


def test_rows_that_are_in_no_pair(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("cell", F.lit("mine")).repartition(1).sortWithinPartitions("id")
    got = cells.similar_pairs(df.where("id != 9 OR id IS NULL"), 0.9).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (1, 2)]
    assert cells.similar_pairs(df.limit(0), 0.9).collect() == [] == cells.similar_pairs(df.where("vec IS NULL"), 0.9).collect()
    assert cells.vector_index(df.limit(0)).search([(1, [1.0, 0.0])], 3).collect() == []


def test_share_of_pairs_skipped(spark):
    m = cells.meeting(frame(spark, grouped(6, 40, 25, 16, 0.15)), FAR)
    assert m.possible == 1000 * 999 // 2 and m.skipped > 0.8, m.skipped
    assert cells.meeting(frame(spark, np.random.default_rng(7).standard_normal((200, 3))), -1.0).compared == 200 * 199 // 2


def nearest(v, q, k):
    sims = np.round(unit(v) @ (q / np.linalg.norm(q)), 6)
    return [(int(i), float(sims[i])) for i in np.lexsort((np.arange(len(v)), -sims))[:k]]


@pytest.mark.parametrize("kind", ["groups", "noise"])
def test_index_is_exact_on_demand_and_recalls(spark, sf, kind):
    v = grouped(8, 30, 40, 16, 0.3) if kind == "groups" else np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    v = v.astype(np.float32).astype(np.float64)
    made = cells.vector_index(frame(spark, v), k=10)
    assert sum(made.rows.values()) == len(v)  # every row is indexed
    asked = [(i, v[i].tolist()) for i in range(0, len(v), 20)] + [(-1, [0.0] * v.shape[1])]
    want = {q: nearest(v, np.array(x), 10) for q, x in asked if q >= 0}
    got = {}
    for r in made.search(asked, 10, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.sim))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    found = {(r.query_id, r.id) for r in made.search(asked, 10).collect()}
    recall = len(found & {(q, i) for q, x in want.items() for i, _ in x}) / sum(map(len, want.values()))
    assert recall >= 0.9
    if kind == "groups":
        assert made.probes < len(made.centres) / 4


def test_a_search_opens_only_its_cells(spark):
    v = grouped(9, 30, 40, 16, 0.2)
    made = cells.vector_index(frame(spark, v), cells=20, k=5)
    order = made.order(unit(v[:1]))[0][:2].tolist()
    files = {r.f for r in made.read(order).select(F.regexp_extract(F.input_file_name(), r"cell=(\d+)/", 1).alias("f")).distinct().collect()}
    assert files <= {str(c) for c in order}
    assert re.search(r"PartitionFilters: \[cell#\d+ IN", made.read(order)._jdf.queryExecution().toString())
    assert made.share(order) < 0.5


def test_tasks_hold_few_rows_against_all_centres(spark, monkeypatch):
    driver, real = os.getpid(), cells.distances

    def strips(rows, centres):
        assert os.getpid() == driver or rows is centres or len(rows) <= 256
        return real(rows, centres)

    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 4)))]
    df = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    monkeypatch.setattr(cells, "distances", strips)
    got = {(r.a, r.b) for r in cells.similar_pairs(df, 0.9).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    x, y = np.nonzero(np.triu(unit @ unit.T > 0.9, 1))
    assert got == set(zip(x.tolist(), y.tolist()))
