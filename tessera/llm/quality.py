"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix, ngram_counts, pieces, prefix_hash, raw, span_hash, words
from .language import held_out

#: Words of a passage.
PASSAGE = 64
#: Numbers of a passage besides its n-grams.
SHAPES = 10
_KIND = np.zeros((256, 5), np.float32)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [65 <= _b <= 90, _b < 128 and _c.isdigit(), _b < 128 and not _c.isalnum() and not _c.isspace(), _b == 10, _b >= 128]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features x hidden
    encode0: np.ndarray
    look: np.ndarray  # hidden x attention (tanh)
    gate: np.ndarray  # hidden x attention (sigmoid)
    pick: np.ndarray  # attention
    out: np.ndarray  # hidden
    out0: np.ndarray


def passages(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the first passage of each text (with the end).

    A text is cut after every PASSAGE words; one without words is a single empty passage. Features are
    logs of hashed counts of byte 1- to 3-grams, and shares: upper case, digits, signs, line ends,
    non-ASCII, words that stand earlier in the passage or in the text, word length, size, the text's length.
    """
    data, off = raw(column)
    start, end, first = words(data, off)
    count = np.diff(first)
    n = np.maximum(1, -(-count // PASSAGE))
    mark = np.concatenate([[0], np.cumsum(n)])
    row_of_word = np.repeat(np.arange(len(count)), count)
    place = mark[row_of_word] + (np.arange(len(start)) - first[row_of_word]) // PASSAGE
    # Each byte belongs to the passage of the last word begun; bytes before the first word to the first passage.
    row = np.repeat(np.arange(len(count)), np.diff(off))
    at_word = np.searchsorted(start, np.arange(len(data)), side="right") - 1 if len(start) else np.zeros(len(data), np.int64)
    own = place[np.maximum(at_word, 0)] if len(start) else np.zeros(len(data), np.int64)
    own = np.maximum(own, mark[row])
    own = np.minimum(own, mark[row + 1] - 1)
    total = mark[-1]
    grams = np.log1p(ngram_counts(data, own, total, (1, 2, 3), dims))
    size = np.bincount(own, minlength=total).astype(np.float32)
    shape = np.zeros((total, SHAPES), np.float32)
    for k in range(5):
        shape[:, k] = np.bincount(own, weights=_KIND[data, k], minlength=total) / np.maximum(size, 1)
    h = span_hash(prefix_hash(data), start, end)
    in_words = np.maximum(np.bincount(place, minlength=total), 1)
    for k, group in ((5, place), (6, row_of_word)):
        _, seen = np.unique(mix(h ^ mix(group.astype(np.uint64))), return_index=True)
        again = np.ones(len(h), bool)
        again[seen] = False
        shape[:, k] = np.bincount(place, weights=again, minlength=total) / in_words
    shape[:, 7] = np.bincount(place, weights=end - start, minlength=total) / in_words
    shape[:, 8] = np.log1p(size)
    shape[:, 9] = np.log1p(np.repeat(count, n))
    return np.hstack([grams, shape]), mark


def _attend(m: Model, x: np.ndarray, mark: np.ndarray):
    h = np.tanh(((x - m.mean) / m.scale) @ m.encode + m.encode0)
    t, g = np.tanh(h @ m.look), 1 / (1 + np.exp(-(h @ m.gate)))
    a = (t * g) @ m.pick
    n = np.diff(mark)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, mark[:-1]), n))
    a /= np.repeat(np.add.reduceat(a, mark[:-1]), n)
    z = np.add.reduceat(a[:, None] * h, mark[:-1], axis=0)
    return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ m.out + m.out0, -30, 30)))


def train(x: np.ndarray, mark: np.ndarray, y: np.ndarray, hidden: int = 16, attention: int = 8, steps: int = 200, seed: int = 3) -> Model:
    """Gated attention and encoder together, from the labels of whole documents (Adam, full batches)."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = Model(x.mean(0), x.std(0) + 1e-3, draw(x.shape[1], hidden), np.zeros(hidden, np.float32), draw(hidden, attention), draw(hidden, attention), draw(attention), draw(hidden), np.zeros(1, np.float32))
    names = ["encode", "encode0", "look", "gate", "pick", "out", "out0"]
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    n, s = np.diff(mark), (x - m.mean) / m.scale
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32) / len(y)
    for step in range(1, steps + 1):
        h, t, g, a, z, p = _attend(m, x, mark)
        d = (p - y) * weight
        dz = d[:, None] * m.out
        each = np.repeat(dz, n, axis=0)
        da = (each * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, mark[:-1]), n))
        dt, dg = ds[:, None] * m.pick * g * (1 - t * t), ds[:, None] * m.pick * t * g * (1 - g)
        dh = (a[:, None] * each + dt @ m.look.T + dg @ m.gate.T) * (1 - h * h)
        grad = {"encode": s.T @ dh + 1e-4 * m.encode, "encode0": dh.sum(0), "look": h.T @ dt, "gate": h.T @ dg, "pick": (t * g).T @ ds, "out": z.T @ d, "out0": d.sum(keepdims=True)}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(m, k, (getattr(m, k) - 0.01 * move).astype(np.float32))
    # Labels count by their shares again: the score is the chance of label 1 among rows like the sample's.
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m.out0 = m.out0 + np.float32(np.log(share / (1 - share)))
    return m


def fit(docs: DataFrame, labels: DataFrame, trained_on, most: int = 3000, dims: int = 256, label_col: str = "quality", most_passages: int = 64) -> Model | None:
    """Fits on labelled rows where ``trained_on`` holds.

    Two documented bounds, for the fit alone: the ``most`` different rows that come first by a hash of doc_id,
    and ``most_passages`` passages of a text, evenly spread over it. Of documents with one doc_id, one text
    counts. So the driver gets most * most_passages passages at most, about 530 bytes each.
    """
    own = labels.where(trained_on & F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("y"))
    picked = own.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    # Broadcast: ``most`` rows of two numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    chosen = chosen.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "y", "first.text")

    def encode(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                x, mark = passages(part.column("text"), dims)
                x = x.astype(np.float16)
                spread = lambda a, b: np.unique(np.linspace(a, b - 1, min(b - a, most_passages)).astype(np.int64))
                each = [x[spread(a, b)].tobytes() for a, b in zip(mark[:-1], mark[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(each, pa.binary())], names=["doc_id", "y", "x"])

    got = map_arrow(chosen, encode, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float32)
    if len(y) == 0:
        return None
    bags = [np.frombuffer(b, np.float16).reshape(-1, dims + SHAPES) for b in got["x"].to_pylist()]
    mark = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags).astype(np.float32), mark, y)


def score(docs: DataFrame, model: Model | None, dims: int = 256) -> DataFrame:
    """One row for each document: doc_id, score, predicted, passages, top_passage (the one attended to most), top_weight.

    Every passage of the whole text is encoded. Null and empty texts have one empty passage and are
    scored as such; without a model every score is 0.5. Other columns are ignored; repeated rows are
    scored as often as they come.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def predict(batches):
        model = sent.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                x, mark = passages(part.column("text"), dims)
                if model is None:
                    p, a = np.full(len(mark) - 1, 0.5), np.ones(len(x))
                else:
                    *_, a, _, p = _attend(model, x, mark)
                top = np.array([int(np.argmax(a[i:j])) for i, j in zip(mark[:-1], mark[1:])])
                p = p.astype(np.float64)
                cols = [part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.diff(mark)), pa.array(top), pa.array(a[mark[:-1] + top].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "passages", "top_passage", "top_weight"])

    return map_arrow(docs.select("doc_id", "text"), predict, "doc_id long, score double, predicted int, passages long, top_passage long, top_weight double")


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels that aren't held out (crc32 of doc_id modulo 3 is 1) and scores all documents."""
    out = held_out(3, 1)
    return score(docs, fit(docs, labels, ~out)).withColumn("held_out", out)
