import numpy as np
import pytest

from tessera.llm import language, quality


def test_codewords():
    for k in (1, 2, 3, 4, 9, 30):
        code = language.codewords(k)
        assert code.shape[0] == k and len({tuple(r) for r in code}) == k
        if k > 1:
            assert (abs(code.sum(0)) < k).all()


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in language.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [i for i in rows if rows[i].held_out and truth[i]]
    assert 20 < len(out) < 90 and sum(rows[i].lang_pred == truth[i] for i in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_odd_rows(odd):
    rows = language.languages(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (1, 2, 6, 7):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    none = language.identify(odd, language.fit(odd.limit(0), language.F.lit(True))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.languages(odd.limit(0)).count() == 0


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.qualities(docs, labels).collect()}
    out = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and all(r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.qualities(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.qualities(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.qualities(odd.limit(0), labels).count() == 0


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(200):
        bag = rng.standard_normal((rng.integers(2, 9), 6)).astype(np.float32)
        y.append(i % 2)
        if i % 2 == 0:
            bag[rng.integers(len(bag)), 0] = 6
        bags.append(bag)
    mark = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    x = np.concatenate(bags)
    model = quality.train(x, mark, np.array(y, np.float32), hidden=8, attention=4)
    p = quality._attend(model, x, mark)[-1]
    assert np.mean((p > 0.5) == np.array(y)) > 0.95


@pytest.mark.parametrize("texts,count", [([""], [1]), (["a " * 64, "a " * 65, "   "], [1, 2, 1])])
def test_passages(texts, count):
    import pyarrow as pa

    x, mark = quality.passages(pa.array(texts), 64)
    assert np.diff(mark).tolist() == count and x.shape == (sum(count), 64 + quality.SHAPES) and np.isfinite(x).all()


def test_bits_are_trusted_by_their_errors():
    y = np.array([[1, 1], [1, 1], [-1, -1], [-1, -1]], np.float32)
    margin = np.array([[2, 2], [2, -2], [-2, -2], [-2, -2]], np.float32)
    trust = language.trusted(margin, y, np.array([0, 0, 1, 1]), 2)
    assert trust[0, 0] > trust[0, 1] and trust[1, 0] == trust[1, 1] and np.allclose(trust.mean(1), 1)


def test_fit_takes_bounded_samples(spark, make):
    rows = [(1, f"the cat and number {i % 300} went out" if i % 2 else f"der hund und nummer {i % 300} ging aus", "en" if i % 2 else "de", "a") for i in range(900)]
    model = language.fit(make(rows), language.F.lit(True), per_label=40)
    assert model.labels == ["de", "en"]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    long = make([(1, "word " * 50_000), (1, "other")])
    assert quality.fit(long, labels, quality.F.lit(True), most_passages=5) is not None
