"""Language identification with error-correcting output codes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ngram_counts, pieces, raw, unit_rows

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of ASCII that aren't letters count as one separator.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray  # labels x bits, -1 or 1
    weights: np.ndarray  # (dims + 1) x bits
    trust: np.ndarray  # labels x bits: what a bit's loss counts for a label


def codewords(classes: int, bits: int = 15, seed: int = 7) -> np.ndarray:
    """A code of +1 and -1, one row for each class: columns are distinct splits of the classes, rows far apart.

    With few classes all 2 ** (classes - 1) - 1 splits are used; else the best of a number of random codes.
    """
    splits = (1 << max(classes - 1, 0)) - 1
    if 0 < splits <= bits:
        return np.array([[1 if c == 0 or (s >> (c - 1)) & 1 else -1 for s in range(splits)] for c in range(classes)])
    rng, best, apart = np.random.default_rng(seed), np.ones((classes, 1), int), -1
    if classes < 2:
        return best
    for _ in range(200):
        code = np.where(rng.random((classes, bits)) < 0.5, -1, 1)
        if (abs(code.sum(0)) == classes).any():
            continue
        near = min(int((code[a] != code[b]).sum()) for a in range(classes) for b in range(a))
        if near > apart:
            best, apart = code, near
    return best


def features(texts: list[str], dims: int) -> np.ndarray:
    """Square roots of hashed counts of byte 2- and 3-grams of the lower-cased text, to unit length, and a constant."""
    data, off = raw(pa.array([f" {t.lower()} " for t in texts], pa.large_string()))
    row = np.repeat(np.arange(len(texts)), np.diff(off))
    data = _PLAIN[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (row[1:] != row[:-1])
    x = unit_rows(np.sqrt(ngram_counts(data[keep], row[keep], len(texts), (2, 3), dims)))
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-5) -> np.ndarray:
    """Logistic regressions of all bits at once (y: rows x bits, -1 or 1), by accelerated gradient steps."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v, rate = w.copy(), 4.0
    for k in range(steps):
        ahead = w + (k / (k + 3)) * v
        grad = x.T @ (-y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))) / len(x) + decay * ahead
        new = ahead - rate * grad
        w, v = new, new - w
    return w.astype(np.float32)


def fit(docs: DataFrame, trained_on, dims: int = 4096, per_label: int = 800, id_col="doc_id", text_col="text", label_col="lang") -> Model:
    """Fits on the rows where ``trained_on`` holds and label and text aren't null.

    The sample is bounded: of each label the ``per_label`` rows that come first by a hash of identifier and
    text; rows that repeat both count once. Only about twice as many are ranked, however many a label has. The whole texts become features on the executors; the driver gets those, about 8 kB a row.

    A bit's loss counts for a label as much as its classifier can be trusted there: each is tried on a
    quarter of the sample that it wasn't fitted on (``trusted``); the classifiers used are fitted on all.
    """
    own = docs.where(trained_on & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(label_col).alias("label"), F.xxhash64(id_col, text_col).alias("_h"), F.col(text_col).alias("text"))
    # Twice as many as wanted are let through by their hash, so that few rows are ranked; a row for each label is broadcast.
    share = own.groupBy("label").agg((F.lit(2.0 * per_label) / F.count("*")).alias("_share"))
    picked = own.select("label", "_h").join(F.broadcast(share), "label").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30)).select("label", "_h").distinct()
    picked = picked.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h"))).where(F.col("_k") <= per_label)
    # Broadcast: per_label numbers for each label.
    chosen = own.join(F.broadcast(picked.select("label", "_h")), ["label", "_h"], "left_semi").dropDuplicates(["label", "_h"]).select("label", "text")

    def encode(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                x = features(part.column("text").to_pylist(), dims)[:, :-1].astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    got = map_arrow(chosen, encode, "label string, x binary").toArrow()
    names = got["label"].to_pylist()
    labels = sorted(set(names))
    code = codewords(len(labels))
    if len(labels) < 2:
        return Model(labels, code, np.zeros((dims + 1, code.shape[1]), np.float32), np.ones(code.shape))
    order = np.random.default_rng(1).permutation(len(names))
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(names), dims).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    at = {label: k for k, label in enumerate(labels)}
    label = np.array([at[n] for n in names])[order]
    x, y = x[order], code[label].astype(np.float32)
    out = np.arange(len(x)) % 4 == 0
    margin = x[out] @ fit_bits(x[~out], y[~out])
    return Model(labels, code, fit_bits(x, y), trusted(margin, y[out], label[out], len(labels)))


def trusted(margin: np.ndarray, y: np.ndarray, label: np.ndarray, labels: int) -> np.ndarray:
    """labels x bits: how far each bit's classifier is above chance on a label's rows (one error and one hit added), 1 on average."""
    right = (margin * y > 0).astype(float)
    rows = np.bincount(label, minlength=labels)[:, None]
    hits = np.array([np.bincount(label, weights=r, minlength=labels) for r in right.T]).T
    above = np.maximum(2 * (hits + 1) / (rows + 2) - 1, 0.02)
    return above / above.mean(1, keepdims=True)


def decode(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the label whose codeword loses least, how sure that is (0 to 1), and the runner-up.

    The loss of a codeword is the sum over its bits of log(1 + exp(-bit * margin)), each bit weighted by ``trust``.
    """
    margin = features(texts, model.weights.shape[0] - 1) @ model.weights
    loss = (model.trust[None, :, :] * np.logaddexp(0, -margin[:, None, :] * model.code[None, :, :])).sum(2)
    order = np.argsort(loss, 1, kind="stable")
    share = np.exp(-(loss - loss.min(1, keepdims=True)))
    best = order[:, 0]
    second = order[:, 1] if loss.shape[1] > 1 else best
    return best, 1 / share.sum(1), second


def identify(docs: DataFrame, model: Model, ambiguous_below: float = 0.6, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each document: id_col, lang_pred, score, ambiguous, runner_up. Whole texts are read.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was
    learned. A best codeword with less than ``ambiguous_below`` of the weight is flagged as ambiguous.
    Other columns are ignored; repeated rows are scored as often as they come.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on dims and the number of labels

    def predict(batches):
        model = sent.value
        for batch in batches:
            for part in pieces(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                known = [bool(model.labels) and _LETTER.search(t) is not None for t in texts]
                best, score, second = decode(model, texts) if model.labels else ([0] * len(texts),) * 3
                rows = [
                    (model.labels[b], float(s), bool(s < ambiguous_below), model.labels[r]) if k else ("und", 0.0, True, None)
                    for k, b, s, r in zip(known, best, score, second)
                ]
                kinds = (pa.string(), pa.float64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=[id_col, "lang_pred", "score", "ambiguous", "runner_up"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), predict, f"{id_col} {kind}, lang_pred string, score double, ambiguous boolean, runner_up string")


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out (crc32 of the identifier modulo 4 is 2) and predicts all."""
    out = held_out(4, 2)
    return identify(docs, fit(docs, ~out)).withColumn("held_out", out)
