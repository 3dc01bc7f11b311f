"""Toxicity behind leetspeak, spacing and repetition: a noisy channel is undone under a character language model, then words are scored."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, stage
from .language import held_out

#: Letters that signs stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Fixed value: signs that are put between the letters of a word.
BETWEEN = "._*-'"
SYMBOLS = 64
#: 0 is the end of a word; then a to z, the small letters of Latin-1, and one for all other letters.
OTHER = 63
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
CODE = {c: i + 1 for i, c in enumerate(_LATIN)}
_TABLE = np.array([OTHER if chr(i).isalpha() else 0 for i in range(1 << 16)] + [0])
for _c, _i in CODE.items():
    _TABLE[ord(_c)] = _i

_SIGNS = re.escape("".join(LEET))
_L = r"[^\W\d_]"
WORDS = re.compile(f"{_L}+")
_B = re.escape(BETWEEN)
#: Signs of a disguise in a token: a sign beside a letter, or something between letters.
ODD = re.compile(rf"[{_SIGNS}{_B}](?:(?<=[{_SIGNS}])(?:(?={_L})|(?<={_L}.))|(?<={_L}.)[{_B}]*(?={_L}))")
SPACE = re.compile(r"\s")
#: Three or more single characters with one or two separators in between, behind white space or an opening sign.
SPACED = re.compile(rf"([\s(\[\"'])((?:{_L}|[{_SIGNS}])(?:[ {_B}]{{1,2}}(?:{_L}|[{_SIGNS}])){{2,}})(?![^\s.,;:!?)\]\"'])")
#: The channel: chances of what is seen, given what is meant. Marks end words more often than they stand for letters.
SIGN, LITERAL, MARK, JOINED, APART, SHUT, OPEN, DOUBLED, ONCE = (math.log(p) for p in (0.3, 0.002, 0.5, 0.02, 0.9, 0.7, 0.3, 0.05, 0.5))
MARKS = "!|+"
#: Names of two weights that aren't words: of texts that hold any word of the lexicon, and of all texts.
ANY, ALL = " any", " all"


def codes_of(text: str) -> np.ndarray:
    """Symbols of a lower-cased text; characters beyond 0xFFFF end words."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each character follows two others, over all documents: SYMBOLS ** 3 numbers, however large the corpus.

    Tasks add up whole texts; one row for each trigram of a task meets in a shuffle.
    """

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                c = np.concatenate([np.zeros(2, np.int64), codes_of("\n".join(t for t in part.column("text").to_pylist() if t).lower()), np.zeros(1, np.int64)])
                a, b, d = c[:-2], c[1:-1], c[2:]
                use = (b > 0) | (d > 0)  # ends of words count once
                key = (np.where(b > 0, a, 0) * SYMBOLS + b) * SYMBOLS + d
                total += np.bincount(key[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["key", "n"])

    got = map_arrow(docs.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def log_chances(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), Witten-Bell: trigrams over bigrams over single characters over all alike."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in (n3.sum((0, 1)), n3.sum(0), n3):
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        lower = (n + np.maximum(kinds, 1) * lower) / (total + np.maximum(kinds, 1))
    return np.log(lower).astype(np.float32)


def symbol(ch: str) -> int:
    got = CODE.get(ch)
    return int(_TABLE[min(ord(ch), 1 << 16)]) if got is None else got


class Decoder:
    """Restores texts; odd tokens that it has restored are remembered, ``most`` at a time."""

    def __init__(self, chances: np.ndarray, most: int = 200_000):
        self.chances, self.lm, self.most, self.known = chances.ravel(), chances.ravel().tolist(), most, {}

    def lattice(self, span: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each run of one character what can be meant by it, with the log chance of seeing it. What isn't a letter ends a word."""
        out = []
        for c, group in itertools.groupby(span):
            n = sum(1 for _ in group)
            if symbol(c):
                out.append([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, DOUBLED)] if n == 2 else [(c, ONCE), (c + c, ONCE)])
            elif c in LEET:
                meant = LEET[c]
                out.append([(c * n, MARK if c in MARKS else LITERAL)] + [(m * k, SIGN) for m in meant for k in ((1,) if n == 1 else (1, 2))])
            elif c in BETWEEN or (spaced and c == " "):
                out.append([("", SHUT), (c * n, OPEN)] if spaced else [("", JOINED), (c * n, APART)])
            else:
                out.append([(c * n, 0.0)])
        return out

    def viterbi(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest of all texts that the lattice holds; states are the last two characters. Exact; of equals the first listed stays."""
        lm = self.lm
        states = {(0, 0): (0.0, None)}
        for options in lattice:
            fresh: dict = {}
            for (a, b), (score, back) in states.items():
                for text, cost in options:
                    x, y, s = a, b, score + cost
                    for ch in text:
                        c = symbol(ch)
                        if c or y:  # a word ends once
                            s += lm[(x * SYMBOLS + y) * SYMBOLS + c]
                        x, y = (y, c) if c else (0, 0)
                    old = fresh.get((x, y))
                    if old is None or s > old[0]:
                        fresh[x, y] = (s, (back, text) if text else back)
            states = fresh
        best, kept = None, None
        for (a, b), (score, back) in states.items():
            score += lm[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0
            if best is None or score > best:
                best, kept = score, back
        parts = []
        while kept:
            kept, text = kept
            parts.append(text)
        return "".join(reversed(parts))

    def plain(self, texts: list[str]) -> list[str]:
        """viterbi() where only letters are repeated: the choice at a run hangs on its two neighbours alone, so all runs are settled at once."""
        u = np.frombuffer("".join(f"\n{t}" for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
        c = _TABLE[np.minimum(u, 1 << 16)]
        same = np.concatenate([[False], (u[1:] == u[:-1]) & (c[1:] > 0)])
        begin = np.flatnonzero(~same[:-1] & same[1:])
        end = np.flatnonzero(same[:-1] & ~same[1:]) + 1
        p, b, s, n = c[begin - 1], c[begin], c[end], end - begin
        two = self.chances[(p * SYMBOLS + b) * SYMBOLS + b] + self.chances[(b * SYMBOLS + b) * SYMBOLS + s]
        one = self.chances[(p * SYMBOLS + b) * SYMBOLS + s] + np.where(n == 2, DOUBLED, 0)
        step = np.zeros(len(u) + 1, np.int64)
        step[begin + np.where((one > two) | ((n > 2) & (one == two)), 1, 2)] += 1
        np.add.at(step, end, -1)
        keep = np.cumsum(step[:-1]) == 0
        left = u[keep]
        size = np.array([len(t) + 1 for t in texts], np.int64)
        mark = np.concatenate([[0], np.cumsum(keep)[np.cumsum(size) - 1]]) if len(texts) else [0]
        return [left[i + 1 : j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(mark[:-1], mark[1:])]

    def token(self, token: str) -> str:
        """A token without white space, restored by viterbi()."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[token] = self.viterbi(self.lattice(token, False))
        return got

    def restore(self, texts: list[str]) -> list[str]:
        """Whole texts in small letters, restored: letters that stand apart, then tokens with odd signs, then repeated letters elsewhere."""
        put = lambda m: m.group(1) + (self.viterbi(self.lattice(m.group(2), True)) if WORDS.search(m.group(2)) else m.group(2))
        parts, odd, marks = [], [], []  # stretches without odd tokens, these tokens, and the stretches of each text
        for text in texts:
            text = SPACED.sub(put, "\n" + text.lower())
            done = 0
            for m in ODD.finditer(text):
                if m.start() < done:
                    continue
                begin = m.start()
                while not text[begin - 1].isspace():  # the first character is a line end
                    begin -= 1
                rest = SPACE.search(text, m.end())
                parts.append(text[done:begin])
                done = rest.start() if rest else len(text)
                odd.append(self.token(text[begin:done]))
            parts.append(text[done:])
            odd.append("")
            marks.append(len(parts))
        joined = [p + o for p, o in zip(self.plain(parts), odd)]
        return ["".join(joined[i:j])[1:] for i, j in zip([0, *marks], marks)]

    def words(self, texts: list[str]) -> list[set[str]]:
        """The distinct words of each restored text."""
        return [set(WORDS.findall(t)) for t in self.restore(texts)]


def restore(docs: DataFrame, chances: np.ndarray) -> DataFrame:
    """doc_id and ``restored``, the whole text as it was meant (null stays null)."""
    sent = docs.sparkSession.sparkContext.broadcast(chances)  # SYMBOLS ** 3 numbers

    def each(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                text = part.column("text").to_pylist()
                done = [None if t is None else r for t, r in zip(text, decoder.restore([t or "" for t in text]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(done, pa.string())], names=["doc_id", "restored"])

    return map_arrow(docs.select("doc_id", "text"), each, "doc_id long, restored string")


def sample(docs: DataFrame, labels: DataFrame, trained_on, chances: np.ndarray, most: int, label_col: str) -> DataFrame:
    """y and the distinct restored words of the sampled documents (near copies once for each label), written to the shared folder."""
    own = labels.where(trained_on & F.col(label_col).isNotNull()).select("doc_id", (F.col(label_col) > 0).cast("int").alias("y"))
    picked = own.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    # Broadcast: ``most`` rows of two numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(chances)

    def each(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                words = [sorted(w) for w in decoder.words([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    rows = map_arrow(chosen.select("y", "text"), each, "y int, words array<string>")
    # Two least hashes of the words: near copies share them, so a text that stands in the sample many times counts once for each label.
    least = [F.array_min(F.transform("words", lambda w, i=i: F.xxhash64(w, F.lit(i)))).alias(f"h{i}") for i in (1, 2)]
    return stage(rows.select("*", *least).groupBy("y", "h1", "h2").agg(F.min("words").alias("words")).select("y", "words"), "sample")


def lexicon(rows: DataFrame, most: int = 4096) -> list[str]:
    """Words that toxic documents have more often than chance explains: G^2 of 2 ln(words) or more, ``most`` at most (the highest)."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    each = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("k"), F.sum("y").alias("k1"))
    part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
    n, n1 = float(size.n), float(size.n1)
    k, k1 = F.col("k").cast("double"), F.col("k1").cast("double")
    g2 = 2 * (part(k1, k * n1 / n) + part(k - k1, k * (n - n1) / n) + part(n1 - k1, (n - k) * n1 / n) + part((n - n1) - (k - k1), (n - k) * (n - n1) / n)) if 0 < n1 < n else F.lit(0.0)
    least = 2 * math.log(max(each.count(), 2))
    over = each.where(k1 * n > k * n1).withColumn("g2", g2).where(F.col("g2") >= least)
    return sorted(r.word for r in over.orderBy(F.desc("g2"), "word").limit(most).collect())


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, decay: float = 0.05, steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression (the last one stands alone) over rows that count n times; Adam, full batches."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, first, second = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    shrink = np.append(np.full(x.shape[1] - 1, decay, np.float32), 0)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + shrink * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = (w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, trained_on, chances: np.ndarray, most: int = 20_000, most_words: int = 1024, label_col: str = "toxic") -> dict[str, float] | None:
    """Weights of words, of ANY of them and of ALL texts, from labelled rows where ``trained_on`` holds; None without any.

    Documented bounds, for the fit alone: the ``most`` different labelled rows that come first by a hash of
    doc_id, and the ``most_words`` words that tell most. So the driver holds most * most_words numbers at most.
    """
    rows = sample(docs, labels, trained_on, chances, most, label_col)
    words = lexicon(rows, most_words)
    at = {w: i for i, w in enumerate(words)}
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    own = rows.select("y", F.array_sort(F.array_intersect("words", known)).alias("w")).groupBy("y", "w").agg(F.count("*").alias("n")).orderBy("y", "w").collect()
    if not own:
        return None
    x = np.zeros((len(own), len(words) + 1), np.float32)
    for i, r in enumerate(own):
        x[i, [at[w] for w in r.w]] = 1
        x[i, -1] = bool(r.w)
    y, n = (np.array([r[k] for r in own], np.float32) for k in ("y", "n"))
    return dict(zip([*words, ANY, ALL], train(x, y, n).tolist()))


def score(docs: DataFrame, weights: dict[str, float] | None, chances: np.ndarray, at_least: float = 0.7) -> DataFrame:
    """One row for each document: doc_id, score, predicted (score >= at_least), hits (the restored words that count as toxic).

    The whole text is restored. Null and empty texts have no words and are scored as such; without weights every
    score is 0.5. Other columns are ignored; repeated rows are scored as often as they come.
    """
    sent = docs.sparkSession.sparkContext.broadcast((weights, chances))  # fixed numbers of words and of trigrams

    def each(batches):
        weights, chances = sent.value
        decoder = Decoder(chances)
        for batch in batches:
            for part in pieces(batch, "text"):
                text = [t or "" for t in part.column("text").to_pylist()]
                found = [sorted(w & weights.keys()) for w in decoder.words(text)] if weights else [[] for _ in text]
                p = np.array([1 / (1 + math.exp(-max(-30.0, min(30.0, weights[ALL] + (weights[ANY] if f else 0) + sum(weights[w] for w in f))))) if weights else 0.5 for f in found])
                cols = [part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= at_least).astype(np.int32)), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "hits"])

    return map_arrow(docs.select("doc_id", "text"), each, "doc_id long, score double, predicted int, hits array<string>")


def toxicities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts characters over all documents, learns from labels that aren't held out (crc32 of doc_id modulo 3 is 1), scores all documents."""
    out = held_out(3, 1)
    chances = log_chances(trigram_counts(docs))
    return score(docs, fit(docs, labels, ~out, chances), chances).withColumn("held_out", out)
