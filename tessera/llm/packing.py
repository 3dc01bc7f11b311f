"""Best-fit packing of documents into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship, stage
from .tokens import default_vocabulary, encoded

#: Pieces of a group at most: short documents are many.
MOST_PIECES = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean, certified boolean"


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32. Null text has the end id alone."""
    path = vocabulary or default_vocabulary()

    def cut(batches):
        for ids, seqs in encoded(batches, path, end_id):
            rows = []
            for i, seq in zip(ids.to_pylist(), seqs):
                for k, at in enumerate(range(0, len(seq), 4 * capacity)):
                    own = seq[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(own) // 4, zlib.crc32(own)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select("doc_id", "text"), cut, PIECES, keep=True)


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs at least: the best of several dual feasible functions.

    A function u with sum(u(x)) <= 1 wherever sum(x) <= 1 gives the bound ceil(sum of u over the items).
    Used are the identity, the stepwise u_k (x -> floor((k + 1) x) / k unless (k + 1) x is whole), and
    the threshold functions (1 above 1 - t, the item itself between, 0 below t).
    """
    if not len(length):
        return 0
    size, n = np.unique(length.astype(np.int64), return_counts=True)
    best = -(-int((size * n).sum()) // capacity)
    for k in range(1, 21):
        at = (k + 1) * size
        u = np.where(at % capacity == 0, size * k, (at // capacity) * capacity)  # over capacity * k
        best = max(best, -(-int((u * n).sum()) // (capacity * k)))
    for t in np.unique(np.concatenate([size[size * 2 <= capacity], [1]])):
        u = np.where(size > capacity - t, capacity, np.where(size >= t, size, 0))
        best = max(best, -(-int((u * n).sum()) // capacity))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. The fullest bin with room is found by a bit for each size of room."""
    bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-length, kind="stable").tolist():
        need = int(length[i])
        fits = mask >> need
        if fits:
            room = need + ((fits & -fits).bit_length() - 1)
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - room
        rooms[room - need].append(b)
        mask |= 1 << (room - need)
    return bins, offsets


def pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """Packs one group anew (or leaves it as it came, where that has fewer bins), certifies it and opens bins for exchange.

    A certified group gives its emptiest bin alone for exchange; a group with a gap to its bound gives
    every bin that isn't nearly full.
    """
    length = table["length"].to_numpy()
    bins, offset = best_fit_decreasing(length, capacity)
    old = table["bin"].to_numpy(zero_copy_only=False)
    was, old_bins = np.unique(old, return_inverse=True)
    if len(was) < bins.max() + 1 and (was >= 0).all():
        bins, offset = old_bins, table["offset"].to_numpy()
    fill = np.bincount(bins, weights=length).astype(np.int64)
    proved = len(fill) == lower_bound(length, capacity)
    give = np.zeros(len(fill), bool)
    give[np.argmin(fill)] = fill.min() < capacity
    if not proved:
        give |= fill < capacity - capacity // 64
    group = int(table["group"][0].as_py())
    new = {"bin": (np.int64(group) << 24) + bins, "offset": offset, "open": give[bins], "certified": np.full(len(bins), proved)}
    keep = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    return pa.table([*(table[c] for c in keep), *(pa.array(v) for v in new.values())], names=[*keep, *new])


def pack(cut: DataFrame, capacity: int = 4096, group_bins: int = 256, rounds: int = 6) -> DataFrame:
    """cut with sequence_id and offset.

    Pieces are dealt by hash to groups of about ``group_bins`` bins, each packed by best-fit decreasing
    in a task of its own and held against its lower bound. Open bins of all groups are then dealt to
    fewer groups and packed again, until a round has one group (or ``rounds`` are over). A group's size
    is bounded by group_bins and MOST_PIECES, whatever the input; only lengths and numbers travel, never texts.
    """
    ship(cut.sparkSession)
    todo = stage(cut.withColumn("row", F.expr("monotonically_increasing_id()")), "pieces")
    todo = todo.withColumns({"bin": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long")})
    done: list[DataFrame] = []
    for r in range(rounds):
        tokens, count = todo.agg(F.sum("length"), F.count("*")).first()
        if tokens is None:
            break
        # What is left gets less from round to round, and is harder to place: groups grow, 64-fold at most.
        groups = max(1, -(-tokens // (capacity * group_bins * min(4**r, 64))), -(-count // MOST_PIECES))
        last = groups == 1 or r == rounds - 1
        # Bins opened before travel whole, so that a group can keep them as they are.
        key = F.when(F.col("bin") < 0, F.xxhash64("row")).otherwise(F.xxhash64("bin"))
        dealt = todo.withColumn("group", F.pmod(key, F.lit(groups)))
        packed = dealt.groupBy("group").applyInArrow(lambda t: pack_group(t, capacity), PACKED)
        packed = stage(packed, f"packed{r}").withColumn("bin", F.col("bin") + F.lit(r + 1) * F.lit(1 << 56))
        if last:
            done.append(packed)
            break
        done.append(packed.where("not open"))
        todo = packed.where("open").drop("open", "certified")
    if not done:
        done = [todo.withColumns({"open": F.lit(False), "certified": F.lit(True)})]
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", "certified")


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs all documents; one row for each piece.

    Only documents longer than ``capacity`` are cut. Null and empty texts are one end id. Repeated rows
    and identifiers are packed as often as they come; null identifiers stay null. An empty table gives
    an empty result; other columns are ignored.
    """
    return pack(cut_pieces(docs, capacity=capacity, end_id=end_id), capacity)
