"""Removal of long repeated byte strings, by longest-previous-factor arrays over sparse suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix, pieces, prefix_hash, raw, span_hash, stage, utf8

#: Bytes of the strings whose smallest hash picks an anchor.
GRAM = 32
#: Contexts of one anchor that are compared in a suffix array; more are compared by fingerprints of whole windows.
MOST_CONTEXTS = 64
ANCHORS = "h long, ctx long, ctx2 long, p int, lo int, hi int"
SPANS = "start int, end int"


def suffix_array(text: bytes) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling."""
    n = len(text)
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    width, order = 1, np.argsort(rank, kind="stable")
    while n:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:] if width < n else []
        order = np.lexsort((second, rank))
        step = np.r_[0, ((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])).astype(np.int64)]
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1 or width >= n:
            break
        width *= 2
    return order


def common_prefixes(text: bytes, order: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each suffix and the one before it in suffix order."""
    n = len(text)
    place, lcp, size = np.empty(n, np.int64), np.zeros(n, np.int64), 0
    place[order] = np.arange(n)
    for i in range(n):
        if place[i] == 0:
            size = 0
            continue
        j = int(order[place[i] - 1])
        while i + size < n and j + size < n and text[i + size] == text[j + size]:
            size += 1
        lcp[place[i]] = size
        size = max(size - 1, 0)
    return lcp


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray, later: bool = False) -> np.ndarray:
    """For each position the length of the longest factor there that also starts earlier (or later) in the text.

    The best earlier start is the previous or the next smaller position in suffix order; both come from
    one pass with a stack. ``later`` mirrors positions.
    """
    n = len(order)
    pos = (n - 1 - order) if later else order
    out, stack = np.zeros(n, np.int64), []  # stack: (index in suffix order, common prefix with the entry below)
    for i in range(n + 1):
        here = int(lcp[i]) if i < n else 0
        at = int(pos[i]) if i < n else -1
        while stack and at < pos[stack[-1][0]]:
            k, with_previous = stack.pop()
            out[order[k]] = max(with_previous, here)  # previous smaller: what is below; next smaller: i
            here = min(here, with_previous)
        if i < n:
            stack.append((i, here if stack else 0))
    return out


def covered(text: bytes, length: int, keep_first: bool = False) -> list[tuple[int, int]]:
    """Maximal runs of bytes of one text covered by strings of ``length`` bytes that also start elsewhere (or earlier) in it."""
    if len(text) < length:
        return []
    order = suffix_array(text)
    lcp = common_prefixes(text, order)
    best = longest_previous_factors(order, lcp)
    if not keep_first:
        best = np.maximum(best, longest_previous_factors(order, lcp, later=True))
    return merge([(int(i), int(i) + length) for i in np.flatnonzero(best >= length)])


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_anchors(data: np.ndarray, off: np.ndarray, length: int):
    """Anchors of every text: row, gram hash, two context hashes, and in the text: the anchor's place, the first and last window it stands for.

    A window of ``length`` bytes belongs to the gram in it with the smallest hash, the leftmost of equals.
    That depends on the window's bytes alone, so equal windows meet at equal grams, at equal distances.
    """
    n, width = len(data), length - GRAM + 1
    sizes = np.diff(off)
    windows = n - length + 1
    if windows <= 0 or (sizes < length).all():
        return (np.zeros(0, np.int64),) * 7
    prefix = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    key = (gram & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    block = padded.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[:windows], left[width - 1 : width - 1 + windows])
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(windows)
    start = start[row[:windows] == row[length - 1 : length - 1 + windows]]
    p = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (row[start[1:]] != row[start[:-1]])]) if len(p) else np.zeros(0, np.int64)
    lo, hi = start[new], start[np.r_[new[1:] - 1, len(p) - 1]] if len(p) else start[new]
    p = p[new]
    owner = row[lo]
    place = mix((p - lo).astype(np.uint64) + np.uint64(1))
    ctx = mix(span_hash(prefix, lo, hi + length) ^ place)
    del prefix
    ctx2 = mix(span_hash(prefix_hash(data, True), lo, hi + length, True) ^ place)
    base = off[owner]
    return owner, gram[p].astype(np.int64), ctx.astype(np.int64), ctx2.astype(np.int64), p - base, lo - base, hi - base


def compare_contexts(texts: list[bytes], at: list[int], ask: list[bool], length: int, keep_first: bool = False):
    """For each context asked about, the runs (relative to its anchor) that another (or an earlier) context of the same anchor repeats.

    ``texts`` come in the order of the corpus; ``at`` is the anchor's place in each. The suffixes from the
    anchors, and the reversed prefixes, are put in suffix order, and previous and next smaller positions give
    each its longest previous factor (and its longest later one): how far any other context can agree with
    it to the right and to the left. Where the two have less than ``length`` bytes together, nothing is
    repeated. For the rest, the common part of two contexts is the smallest common prefix between them in
    suffix order, and a pair whose common parts have ``length`` bytes together repeats all of that stretch.
    """
    k = len(texts)

    def ordered(strings: list[bytes]):
        order = sorted(range(k), key=strings.__getitem__)
        lcp = [0]
        for i, j in zip(order, order[1:]):
            a, b = strings[i], strings[j]
            m = min(len(a), len(b))
            x, y = np.frombuffer(a, np.uint8, m), np.frombuffer(b, np.uint8, m)
            d = np.flatnonzero(x != y)
            lcp.append(int(d[0]) if len(d) else m)
        order, lcp = np.array(order, np.int64), np.array(lcp, np.int64)
        factor = longest_previous_factors(order, lcp)
        return order, lcp, factor if keep_first else np.maximum(factor, longest_previous_factors(order, lcp, later=True))

    def common(order, lcp, i: int) -> np.ndarray:
        """Common prefix of i's string with each."""
        place = int(np.flatnonzero(order == i)[0])
        out = np.zeros(k, np.int64)
        out[order[place + 1 :]] = np.minimum.accumulate(lcp[place + 1 :])
        out[order[:place]] = np.minimum.accumulate(lcp[1 : place + 1][::-1])[::-1]
        return out

    right, left = ordered([t[a:] for t, a in zip(texts, at)]), ordered([t[:a][::-1] for t, a in zip(texts, at)])
    for i in np.flatnonzero((right[2] + left[2] >= length) & np.array(ask, bool)).tolist():
        r, l = common(*right[:2], i), common(*left[:2], i)  # noqa: E741
        hit = np.flatnonzero(r + l >= length)
        if keep_first:
            hit = hit[hit < i]
        if len(hit):
            yield i, merge((-int(l[j]), int(r[j])) for j in hit)


def repeated_spans(keyed: DataFrame, length: int, keep_first: bool = False) -> DataFrame:
    """Stretches of the texts (k, text) covered by repeated strings: k, start, end; they may overlap.

    1. Every text's anchors are found (about one for each 185 bytes at 400). Anchors whose whole context
       (all windows they stand for; told by two 64-bit hashes) occurs again are settled by that: one count by (gram, context).
    2. The rest of the anchors whose gram occurs with other contexts, up to MOST_CONTEXTS of them, are
       compared in suffix order by their longest previous factors, on their bytes.
    3. Grams with more contexts than that (where a very common passage begins or ends) are settled by two
       fingerprints of each window, counted over all tasks, so no task holds a gram's contexts.

    With ``keep_first`` only what stands earlier counts (texts in the order of k, which has to sort).
    """
    kind = keyed.schema["k"].dataType.simpleString()

    def anchors(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                owner, *hashes, p, lo, hi = find_anchors(*raw(part.column("text")), length)
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in hashes), *(pa.array(x, pa.int32()) for x in (p, lo, hi))], names=["k", "h", "ctx", "ctx2", "p", "lo", "hi"])

    found = stage(map_arrow(keyed, anchors, f"k {kind}, {ANCHORS}"), "anchors")
    same = ["h", "ctx", "ctx2"]
    contexts = found.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct("k", "p", "lo", "hi")).alias("at"))
    again = contexts.groupBy("h").agg(F.sum("c").alias("n"), F.count("*").alias("contexts")).where("n > 1")
    contexts = stage(contexts.join(again.drop("n"), "h"), "contexts")
    settled = found.join(contexts.where("c > 1").select(*same, F.col("at.k").alias("k0"), F.col("at.p").alias("p0")), same)
    if keep_first:
        settled = settled.where("k != k0 OR p != p0")
    spans = settled.select("k", F.col("lo").alias("start"), (F.col("hi") + length).cast("int").alias("end"))

    open_ = contexts.where("contexts > 1").select("h", "c", "contexts", "at.*")
    by_text = open_.groupBy("k").agg(F.collect_list(F.struct("h", "c", "contexts", "p", "lo", "hi")).alias("of"))
    by_text = stage(by_text, "open")
    with_text = keyed.join(by_text, "k")  # k is a struct, so a null identifier equals itself

    def cut(batches):
        names = ["h", "k", "p", "lo", "c", "window", "window2", "bytes"]
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for k, text, of in zip(*(part.column(c).to_pylist() for c in ("k", "text", "of"))):
                    data = text.encode() if isinstance(text, str) else text
                    prefix = None
                    for x in of:
                        if x["contexts"] <= MOST_CONTEXTS:
                            rows.append((x["h"], k, x["p"], x["lo"], x["c"], None, None, data[x["lo"] : x["hi"] + length]))
                            continue
                        flat = np.frombuffer(data, np.uint8)
                        prefix = (prefix_hash(flat), prefix_hash(flat, True)) if prefix is None else prefix
                        at = np.arange(x["lo"], x["hi"] + 1)
                        both = [span_hash(prefix[f], at, at + length, bool(f)).astype(np.int64).tolist() for f in (0, 1)]
                        rows.append((x["h"], k, x["p"], x["lo"], x["c"], *both, None))
                kinds = (pa.int64(), part.column("k").type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    parts = map_arrow(with_text.select("k", "text", "of"), cut, f"h long, k {kind}, p int, lo int, c long, window array<long>, window2 array<long>, bytes binary")
    parts = stage(parts.dropDuplicates(["h", "k", "p"]), "cut")

    def compare(batches):
        held: list = []

        def settle(group):
            # Sorted in the order of the corpus. One that occurs again as a whole is settled, unless it is the first of its kind.
            texts = [g[4] for g in group]
            found = compare_contexts(texts, [g[1] - g[2] for g in group], [keep_first or g[3] == 1 for g in group], length, keep_first)
            return [(group[i][0], group[i][1] + a, group[i][1] + b) for i, runs in found for a, b in runs]

        def out(rows, kind):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int32(), pa.int32()))], names=["k", "start", "end"])

        last = kind = None
        for batch in batches:
            rows, kind = [], batch.column("k").type
            for h, *rest in zip(*(batch.column(c).to_pylist() for c in ("h", "k", "p", "lo", "c", "bytes"))):
                if h != last and held:
                    rows += settle(held)
                    held = []
                last = h
                held.append(rest)
            yield out(rows, kind)
        if held:
            yield out(settle(held), kind)

    few = parts.where("bytes IS NOT NULL").select("h", "k", "p", "lo", "c", "bytes").repartition("h").sortWithinPartitions("h", "k", "p")
    compared = map_arrow(few, compare, f"k {kind}, {SPANS}")

    single = parts.where("window IS NOT NULL").select("h", "k", "c", "lo", F.posexplode(F.arrays_zip("window", "window2")).alias("i", "w"))
    single = single.select("h", "k", "c", (F.col("lo") + F.col("i")).alias("start"), "w.window", "w.window2")
    first = F.min(F.struct("k", "start")).alias("first")
    counts = stage(single.groupBy("h", "window", "window2").agg(F.count("*").alias("n"), first).where("n > 1").select("h", "window", "window2", F.col("first.k").alias("k0"), F.col("first.start").alias("start0")), "windows")
    hits = (single if keep_first else single.where("c = 1")).join(counts, ["h", "window", "window2"])
    if keep_first:
        hits = hits.where("k != k0 OR start != start0")
    hits = hits.select("k", F.col("start").cast("int").alias("start"), (F.col("start") + length).cast("int").alias("end"))
    return spans.unionByName(compared).unionByName(hits)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """One row for each document: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run).

    Texts are UTF-8 bytes (null: empty). A byte goes if it lies in a string of ``length`` bytes that also
    starts anywhere else, in the same document or another; with ``keep_first``, only if it starts earlier: in
    the same document or one with a smaller identifier (nulls first; of one identifier by a hash of the
    text, and then rows that repeat both count as one). Strings are judged on the input, and matches
    never cross documents. Texts shorter than ``length`` stay whole. Copies of a document, repeated rows
    among them, remove each other. Null identifiers are fine. An empty table gives an empty result; other
    columns are ignored.
    """
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t")).alias("k")
    keyed = docs.select(key, F.coalesce(text_col, F.lit("")).alias("text"))
    if keep_first:
        keyed = keyed.dropDuplicates(["k"])
    spans = repeated_spans(keyed, length, keep_first)
    # At most one for each anchor or window of a text, so as long as the text at most.
    by_text = stage(spans.distinct().groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("of")), "spans")
    whole = docs.select(F.col(id_col).alias("_id"), key, utf8(F.col(text_col)).alias("bytes"))
    both = whole.join(by_text, whole["k"].eqNullSafe(by_text["k"]), "left")

    def strip(batches):
        for batch in batches:
            rows = []
            for i, data, of in zip(*(batch.column(c).to_pylist() for c in ("_id", "bytes", "of"))):
                runs = merge((x["start"], x["end"]) for x in of or [])
                at, kept = 0, hashlib.sha256()
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((i, len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            kinds = (batch.column("_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return map_arrow(both.select("_id", "bytes", "of"), strip, schema)
