"""Jaccard self-join on word n-grams with a count-vector R-tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import fold, map_arrow, mix, pieces, prefix_hash, raw, release, span_hash, stage, words

#: Coordinates of a point: tokens are hashed into so many groups.
GROUPS = 128
#: Bits of an odd sketch: at least 4 for each n-gram, within these bounds.
LEAST_BITS, MOST_BITS = 512, 1 << 14
#: Points of an R-tree leaf, children of an inner node, and rows of a tile (the part of a bucket that one task holds) on average.
LEAF, FAN, TILE = 32, 8, 512
#: Frequent n-grams that are kept at most, and documents that are sampled to find them.
MOST_FREQUENT, SAMPLE = 50_000, 20_000
#: Pairs of nodes or points that are compared at a time.
AT_ONCE = 1 << 14
#: Pairs that a task remembers; it forgets them all beyond that, and passes some on again.
MOST_SEEN = 500_000
#: Identifiers that are broadcast at most.
MOST_BROADCAST = 400_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
# Verification has n-grams of another family: a link needs equal hashes of both, 128 bits.
_K2 = [np.uint64(int(k) * 0xFF51AFD7ED558CCD % (1 << 64)) for k in _K]


def shingle_sets(column: pa.Array, n: int, multipliers=_K):
    """For each text: the sorted, distinct 64-bit hashes of its n-grams, and two 64-bit hashes of its whole word sequence.

    With fewer than n words the whole sequence is one n-gram; without words the set is empty.
    """
    data, off = raw(column)
    data = fold(data)
    start, end, first = words(data, off)
    h = span_hash(prefix_hash(data), start, end)
    grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * multipliers[k]
    grams = mix(grams)
    last = lambda x: int(mix(np.array([x]))[0].astype(np.int64))
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            yield np.zeros(0, np.uint64), 0, 0
            continue
        size = np.uint64(b - a)
        own = grams[a : b - n + 1] if b - a >= n else mix(np.array([(h[a:b] * np.array(multipliers[: b - a])).sum() + size]))
        place = mix(np.arange(b - a, dtype=np.uint64) + np.uint64(1))
        yield np.unique(own), last(mix(h[a:b] ^ place).sum() + size), last((mix(h[a:b] * _K2[0] ^ place) * (place | np.uint64(1))).sum() ^ size)


def least_overlap(a, b, percent: int):
    """Common n-grams that two sets need at least: 100 * both >= percent * either."""
    return -(-percent * (a + b) // (100 + percent))


def points(sets: np.ndarray) -> np.ndarray:
    """The count vector of a set: how many of its n-grams fall into each group."""
    return np.bincount((sets & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def odd_sketch(sets: np.ndarray) -> bytes:
    """A bit for each group of n-grams: whether the set has an odd number of them. The number of bits is a power of two."""
    bits = LEAST_BITS
    while bits < min(4 * len(sets), MOST_BITS):
        bits *= 2
    count = np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def differing(p: bytes, q: bytes) -> int:
    """N-grams that are in one of two sets only, at least: a bit differs only where their number in its group is odd. Two halves of a sketch make the shorter one."""
    x, y, n, m = int.from_bytes(p), int.from_bytes(q), len(p), len(q)
    while n > m:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    while m > n:
        m //= 2
        y = (y >> 8 * m) ^ (y & ((1 << 8 * m) - 1))
    return (x ^ y).bit_count()


def close(odd, x, odd2, y, spare) -> np.ndarray:
    """Which pairs (places x of odd, y of odd2) differ in no more n-grams than ``spare`` allows, as far as the sketches tell."""
    return np.fromiter((differing(odd[i], odd2[j]) <= s for i, j, s in zip(x.tolist(), y.tolist(), spare.tolist())), bool, len(x))


def survivors(one: "Tree", lo: slice, two: "Tree", hi: slice, same: bool, percent: int):
    """Pairs of points from two leaves that neither the summed minima of their coordinates nor their odd sketches, where there are any, can rule out."""
    v, w, n, m = one.vec[lo], two.vec[hi], one.n[lo], two.n[hi]
    need = least_overlap(n[:, None], m[None, :], percent)
    able = (one.comp[lo][:, None] != two.comp[hi][None, :]) & (np.minimum(n[:, None], m[None, :]) >= need)
    if same:
        able &= np.triu(np.ones(able.shape, bool), 1)
    x, y = np.nonzero(able)
    if len(x):
        ok = np.minimum(v[x], w[y]).sum(1) >= need[x, y]
        x, y = x[ok], y[ok]
        if one.odd is not None:
            ok = close(one.odd[lo], x, two.odd[hi], y, n[x] + m[y] - 2 * need[x, y])
            x, y = x[ok], y[ok]
    return one.ids[lo][x], two.ids[hi][y]


class Tree:
    """Packed R-tree over count vectors: points sorted by component, size and coordinates, LEAF to a leaf, FAN nodes to a node above.

    A node has the largest value of each coordinate below it, and its ranges of sizes and components.
    """

    def __init__(self, ids, n, comp, vec, odd=None):
        order = np.lexsort((vec[:, 0], n, comp))
        self.ids, self.n, self.comp, self.vec = ids[order], n[order], comp[order], vec[order]
        self.odd = None if odd is None else odd[order]
        self.levels = [self._above((self.vec, self.n, self.n, self.comp, self.comp), LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._above(self.levels[-1], FAN))

    @staticmethod
    def _above(level, width):
        at = np.arange(0, len(level[0]), width)
        return tuple(f.reduceat(x, at, axis=0) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, nodes, k: int):
        """First child and number of children of nodes of level k (the root stands for itself above the tree)."""
        if k >= len(self.levels):
            return nodes, np.ones(len(nodes), np.int64)
        return nodes * FAN, np.minimum(FAN, len(self.levels[k - 1][0]) - nodes * FAN)

    def points(self, leaf: int) -> slice:
        return slice(leaf * LEAF, (leaf + 1) * LEAF)


def open_nodes(one, two, percent: int) -> np.ndarray:
    """Which pairs of nodes (coordinates' maxima, sizes from, to, components from, to) may hold a pair that is similar enough."""
    need = least_overlap(one[1], two[1], percent)
    ok = np.minimum(one[2], two[2]) >= need
    ok &= ~((one[3] == one[4]) & (two[3] == two[4]) & (one[3] == two[3]))
    at = np.flatnonzero(ok)
    ok[at] = np.minimum(one[0][at], two[0][at]).sum(1) >= need[at]
    return ok


def tree_join(one: Tree, percent: int, two: Tree | None = None):
    """Pairs of points of different components (of one tree, or one of each) that summed coordinate minima can't rule out.

    Both trees are descended together from their roots: a pair of nodes is opened only if the summed
    minima of their maxima reach the overlap that their smallest sets need.
    """
    own, other = two is None, two or one
    top = max(len(one.levels), len(other.levels)) - 1
    todo, out = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))], []
    while todo:
        k, i, j = todo.pop()
        if len(i) > AT_ONCE:
            todo += [(k, i[at : at + AT_ONCE], j[at : at + AT_ONCE]) for at in range(0, len(i), AT_ONCE)]
            continue
        ok = open_nodes([x[i] for x in one.level(k)], [x[j] for x in other.level(k)], percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k:
            (p, np_), (q, nq) = one.children(i, k), other.children(j, k)
            each = np_ * nq
            at = np.repeat(np.arange(len(i)), each)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            i, j = p[at] + nth // nq[at], q[at] + nth % nq[at]
            if own:
                i, j = i[i <= j], j[i <= j]
            todo.append((k - 1, i, j))
            continue
        for a, b in zip(i.tolist(), j.tolist()):
            out.append(survivors(one, one.points(a), other, other.points(b), own and a == b, percent))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


PAIRS = "a long, b long"


def _pair_batch(a, b):
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["a", "b"])


def _sketches(column) -> np.ndarray:
    return np.array([*column.to_pylist(), None], object)[:-1]


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, GROUPS)


INFO = ("n", "vec", "odd", "rep_id", "rep_hash")
NEAR = "a long, b long, a_id long, a_hash long, b_id long, b_hash long"


def bounded(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that sizes, summed minima and odd sketches can't rule out, with where their texts are (NEAR)."""
    side = lambda k: info.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in INFO])
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    joined = joined.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("a_n", "b_n"))
            need = least_overlap(na, nb, percent)
            ok = np.minimum(_vectors(batch.column("a_vec")), _vectors(batch.column("b_vec"))).sum(1) >= need
            at = np.flatnonzero(ok)
            ok[at] = close(_sketches(batch.column("a_odd")), at, _sketches(batch.column("b_odd")), at, (na + nb - 2 * need)[at])
            names = ["a", "b", "a_rep_id", "a_rep_hash", "b_rep_id", "b_rep_hash"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in names], names=["a", "b", "a_id", "a_hash", "b_id", "b_hash"])

    return map_arrow(joined.select("a", "b", *[f"{k}_{c}" for k in "ab" for c in INFO]), keep, NEAR)


def tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs of different components inside each tile; rows (token, tile, id, n, comp, vec, odd) come sorted by tile.

    Pairs that the count vectors let through are held against the odd sketches before they leave the task: near misses of a large group stay here.
    """

    def join(batches):
        seen: set = set()  # long texts meet in hundreds of buckets; a task passes a pair on once
        for found in searched(batches):
            pairs = [p for p in zip(found.column("a").to_pylist(), found.column("b").to_pylist()) if p not in seen]
            if len(seen) > MOST_SEEN:
                seen.clear()
            seen.update(pairs)
            fresh = list(dict.fromkeys(pairs))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in fresh], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def searched(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = table["token"].to_numpy(), table["tile"].to_numpy()
            cut = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            if not len(cut):
                continue
            yield from work(table.slice(0, int(cut[-1])), cut[:-1])
            held = table.slice(int(cut[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            key = table["token"].to_numpy(), table["tile"].to_numpy()
            yield from work(table, np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1)

    def work(table, cut):
        ids, n, comp = table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["comp"].to_numpy()
        vec, odd = _vectors(table["vec"]), _sketches(table["odd"])  # of the tiles in one batch
        mark = np.concatenate([[0], cut, [len(ids)]]).astype(np.int64)
        size = np.diff(mark)
        for m in np.unique(size[(size > 1) & (size <= 8)]):  # small tiles of one size at once
            base = mark[:-1][size == m]
            x, y = np.triu_indices(m, 1)
            i, j = (base[:, None] + x).ravel(), (base[:, None] + y).ravel()
            need = least_overlap(n[i], n[j], percent)
            ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= need)
            i, j, need = i[ok], j[ok], need[ok]
            ok = np.zeros(len(i), bool)
            for k in range(0, len(i), AT_ONCE):
                s = slice(k, k + AT_ONCE)
                ok[s] = np.minimum(vec[i[s]], vec[j[s]]).sum(1) >= need[s]
            i, j, need = i[ok], j[ok], need[ok]
            ok = close(odd, i, odd, j, n[i] + n[j] - 2 * need)
            if ok.any():
                yield _pair_batch(ids[i[ok]], ids[j[ok]])
        for a, b in zip(mark[:-1][size > 8], mark[1:][size > 8]):
            x, y = tree_join(Tree(ids[a:b], n[a:b], comp[a:b], vec[a:b], odd[a:b]), percent)
            if len(x):
                yield _pair_batch(x, y)

    return map_arrow(rows.select("token", "tile", "id", "n", "comp", "vec", "odd"), join, PAIRS)


DIRECTORY = "token long, tile long, top binary, least int, most int, comp_lo long, comp_hi long"


def cross_tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs between the tiles of one bucket.

    Each tile is the root of a tree. A directory has what the roots have (a row for each tile); tiles meet
    only where the directory's bound lets a pair of them through, and tiles that are all of one component
    never meet another of it. Two tiles are then descended together.
    """
    packed = stage(rows.groupBy("token", "tile").agg(F.collect_list(F.struct("id", "n", "comp", "vec", "odd")).alias("of")), "tiles")

    def tree(of) -> Tree:
        return Tree(of.field("id").to_numpy(), of.field("n").to_numpy().astype(np.int64), of.field("comp").to_numpy(), _vectors(of.field("vec")), _sketches(of.field("odd")))

    def roots(batches):
        for batch in batches:
            found = [[x[0] for x in tree(p.values).levels[-1]] for p in batch.column("of")]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            cols = [pa.array([f[0].astype(np.uint32).tobytes() for f in found], pa.binary()), *(pa.array([int(f[k + 1]) for f in found], t) for k, t in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("tile"), *cols], names=["token", "tile", "top", "least", "most", "comp_lo", "comp_hi"])

    directory = stage(map_arrow(packed, roots, DIRECTORY), "directory")
    fields = ("tile", "top", "least", "most", "comp_lo", "comp_hi")
    side = lambda k: directory.select("token", *[F.col(c).alias(f"{c}{k}") for c in fields])
    differ = "tile1 < tile2 AND NOT (comp_lo1 = comp_hi1 AND comp_lo2 = comp_hi2 AND comp_lo1 = comp_lo2)"
    met = side(1).join(side(2), "token").where(differ).where(100 * F.least("most1", "most2") >= percent * F.greatest("least1", "least2"))

    def meet(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = [[_vectors(batch.column(f"top{k}")), *(batch.column(f"{c}{k}").to_numpy().astype(np.int64) for c in fields[2:])] for k in (1, 2)]
            ok = pa.array(open_nodes(*nodes, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("token", "tile1", "tile2")], names=["token", "tile1", "tile2"])

    met = stage(map_arrow(met, meet, "token long, tile1 long, tile2 long"), "met")
    of = lambda k: packed.select("token", F.col("tile").alias(f"tile{k}"), F.col("of").alias(f"o{k}"))

    def join(batches):
        for batch in batches:
            for p, q in zip(batch.column("o1"), batch.column("o2")):
                x, y = tree_join(tree(p.values), percent, tree(q.values))
                if len(x):
                    yield _pair_batch(x, y)

    return map_arrow(met.join(of(1), ["token", "tile1"]).join(of(2), ["token", "tile2"]).select("o1", "o2"), join, PAIRS)


def verify(near: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of near (NEAR) whose n-gram sets, made anew from the whole texts, are similar enough (written).

    The sets are those of the second family of hashes, so no link rests on 64 bits alone.
    """
    ends = [near.select(F.col(k).alias("id"), F.col(f"{k}_id").alias("_id"), F.col(f"{k}_hash").alias("_hash")) for k in "ab"]
    wanted = stage(ends[0].unionByName(ends[1]).distinct(), "wanted")
    # Broadcast only as far as MOST_BROADCAST rows of three numbers, as just counted.
    few = wanted.count() <= MOST_BROADCAST
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    own = own.join(F.broadcast(wanted) if few else wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def make(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [s.tobytes() for s, *_ in shingle_sets(part.column("text"), n, _K2)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "grams"])

    sets = stage(map_arrow(own.select("id", "text"), make, "id long, grams binary").dropDuplicates(["id"]), "sets")
    left = near.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")

    def check(batches):
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ga", "gb"))):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(p) and len(q):
                    at = np.searchsorted(q, p)
                    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = stage(map_arrow(both, check, PAIRS), "links")
    release(sets, wanted)
    return links


def frequent_ngrams(docs: DataFrame, n: int, rows: int) -> np.ndarray:
    """N-grams that many documents of a bounded sample share. They only decide an order, so any set gives the same result."""
    fraction = min(1.0, SAMPLE / max(rows, 1))

    def grams(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [s for s, *_ in shingle_sets(part.column("text"), n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], names=["g"])

    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(fraction * (1 << 20))).select("text")
    count = map_arrow(some, grams, "g long").groupBy("g").agg(F.count("*").alias("c")).where("c >= 8").orderBy(F.desc("c"), "g").limit(MOST_FREQUENT)
    return np.sort(np.array([r.g for r in count.collect()], np.int64).astype(np.uint64))


def ngram_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    See ``ngram_groups``, which tells rows with one identifier and different texts apart.
    """
    return ngram_groups(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, comp (the component's number; null for an empty set).

    Two documents link when 100 * common n-grams >= percent * n-grams of either (words are lower-cased in
    A-Z only and cut at ASCII white space). Documents without words have an empty set, link with nothing and
    are components of their own. Null text counts as empty, repeated rows share a class, a null doc_id is
    passed over when components are named. An empty table gives an empty result; other columns are ignored.

    Documents with equal word sequences (by two 64-bit hashes) are one class, which goes on as one point. Classes meet in
    buckets: each class goes to the buckets of its first n - ceil(percent n / 100) + 1 n-grams in an order
    that puts frequent ones last, so two similar classes share at least one. Links are found in two rounds.

    1. In each bucket every class is paired with the bucket's most central one. The pairs that the
       count vectors' bound lets through are verified on the sets, and components are formed: groups of
       near copies fall together without a pair for every two members.
    2. Buckets that still hold several components are searched by R-tree for pairs of different
       components: buckets in tiles of about 512 points (a component that fills a tile has its own), a tree
       for each tile and a directory of the trees' roots; summed minima of coordinates rule out
       nodes, then points, and odd sketches pairs of points; what is left is verified on the sets. Nothing is done where no such bucket is left.
    """
    rows = docs.count()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_ngrams(docs, n, rows))  # MOST_FREQUENT numbers at most

    def describe(batches):
        often = frequent.value
        for batch in batches:
            known: set[tuple[int, int]] = set()  # of this batch: copies need their buckets once
            for part in pieces(batch, "text"):
                count, key, key2, first, vec, odd = [], [], [], [], [], []
                for grams, seq, seq2 in shingle_sets(part.column("text"), n):
                    count.append(len(grams))
                    key.append(seq if len(grams) else None)
                    key2.append(seq2 if len(grams) else None)
                    if not len(grams) or (seq, seq2) in known:
                        first.append(None)
                        vec.append(None)
                        odd.append(None)
                        continue
                    known.add((seq, seq2))
                    if len(often):
                        late = often[np.minimum(np.searchsorted(often, grams), len(often) - 1)] == grams
                        ordered = np.concatenate([grams[~late], grams[late]])
                    else:
                        ordered = grams
                    take = len(grams) - -(-percent * len(grams) // 100) + 1
                    first.append(ordered[:take].astype(np.int64))
                    vec.append(points(grams).tobytes())
                    odd.append(odd_sketch(grams))
                cols = [pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.array(count, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(vec, pa.binary()), pa.array(odd, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *cols], names=["doc_id", "text_hash", "id", "id2", "n", "first", "vec", "odd"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    whole = stage(map_arrow(keyed, describe, "doc_id long, text_hash long, id long, id2 long, n int, first array<long>, vec binary, odd binary"), "described")

    def classes(described):
        point = F.first(F.when(F.col("vec").isNotNull(), F.struct("n", "vec", "odd", "first")), ignorenulls=True)
        rep = F.min(F.struct(F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash")))
        each = described.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"), rep.alias("rep"), point.alias("point"), F.min("id2").alias("lo2"), F.max("id2").alias("hi2"))
        return stage(each.select("id", "doc_id", "rep.*", "point.*", "lo2", "hi2"), "classes")

    info = classes(whole)
    clash = info.where("lo2 != hi2").select("id", F.lit(True).alias("clash"))
    if clash.limit(1).count():  # two sequences of one 64-bit hash: both hashes name the class
        whole = whole.join(clash, "id", "left").withColumn("id", F.when(F.col("clash"), F.xxhash64("id", "id2")).otherwise(F.col("id"))).drop("clash")
        whole = stage(whole, "described")
        info = classes(whole)
    described = stage(whole.select("doc_id", "text_hash", "id", "n"), "sizes")
    release(whole)

    post = info.select("id", F.explode("first").alias("token"))
    shared = post.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("lo != hi")
    posts = stage(post.join(shared, "token").select("token", "id", "c"), "postings")
    # The pivot of a bucket is the member with most company in all its buckets: of a group of copies, what they are copies of.
    central = posts.groupBy("id").agg(F.sum("c").alias("weight"))
    pivot = posts.join(central, "id").groupBy("token").agg(F.max(F.struct("weight", "id")).alias("top"))
    star = posts.join(stage(pivot.select("token", F.col("top.id").alias("pivot")), "pivots"), "token").where("id != pivot")
    star = star.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    near = stage(bounded(star, info, percent), "near")
    links = verify(near, docs, n, percent)
    comps = stage(components(links), "components")

    placed = posts.select("token", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = stage(placed.select("token", "id", "comp"), "placed")
    # Buckets with the very same members (two long texts share hundreds) give the same pairs: one of them is searched.
    member = [F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("again"), "id")).alias("x2"), F.min("id").alias("i1"), F.max("id").alias("i2")]
    buckets = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *member).where("lo != hi")
    mixed = stage(buckets.groupBy("x1", "x2", "i1", "i2", "m").agg(F.min("token").alias("token")).select("token", "m"), "mixed")
    largest = mixed.agg(F.max("m")).first()[0]
    release(posts)
    if largest:
        found = stage(bounded(between(placed.join(mixed, "token"), info, largest, percent).join(near, ["a", "b"], "left_anti"), info, percent), "found")
        more = verify(found, docs, n, percent)
        up = lambda k: comps.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}"))
        merged = more.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        again = components(merged).withColumnRenamed("node", "_c").withColumnRenamed("comp", "_top")
    named = info.select("id", "doc_id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "doc_id")
    if largest:
        named = named.join(again, F.col("comp") == F.col("_c"), "left").select("id", F.coalesce("_top", "comp").alias("comp"), "doc_id")
    named = stage(named, "named")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of = stage(named.join(least, "comp").select("id", "comp", "component_id"), "members")
    return described.join(of, "id", "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "comp")


def between(rows: DataFrame, info: DataFrame, largest: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b; written) of different components in one bucket that the R-trees don't rule out. rows: token, id, comp, m (rows of the bucket)."""
    tile = F.lit(0).cast("long")
    if largest > TILE:
        rows = stage(rows, "mixed_rows")
        parts = lambda c: F.ceil(F.col(c) / TILE)
        full = rows.where(F.col("m") > TILE).groupBy("token", "comp").agg(F.count("*").alias("own")).where(F.col("own") > TILE)
        rows = rows.join(stage(full, "full"), ["token", "comp"], "left")
        tile = F.when(F.col("own").isNotNull(), F.xxhash64("comp", F.pmod(F.xxhash64("id"), parts("own")))).when(F.col("m") > TILE, F.pmod(F.xxhash64("comp"), parts("m"))).otherwise(tile)
    tiled = rows.withColumn("tile", tile).join(info.select("id", "n", "vec", "odd"), "id").select("token", "tile", "m", "id", "n", "comp", "vec", "odd")
    tiled = stage(tiled, "tiled")
    pairs = tile_pairs(tiled.repartition("token", "tile").sortWithinPartitions("token", "tile"), percent)
    if largest > TILE:
        pairs = pairs.unionByName(cross_tile_pairs(tiled.where(F.col("m") > TILE), percent))
    # Written: else the anti-join that follows would be moved below the distinct, and see each pair once for every task.
    return stage(pairs.distinct(), "pairs")
