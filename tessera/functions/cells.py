"""Cells of vectors: an exact similarity join and a vector index, both with the triangle's bound.

Vectors are compared by cosine, which orders pairs as their distance on the unit sphere does
(d^2 = 2 - 2 cos), and distances obey the triangle's inequality: what is far from a cell's centre is far
from all that lies near it. Centres are learned from a bounded sample; which cell a vector falls into
changes how much work there is, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import new_path, ship, stage

#: Rows that centres are learned from, centres, and rounds of learning, at most.
SAMPLE, MOST_CELLS, ROUNDS = 8192, 1024, 8
#: Rows of a block (half of what one task multiplies) and of a file of the index.
BLOCK, FILE_ROWS = 4096, 100_000
#: Rows that a task holds against all centres, or all rows of another block, at a time.
STRIP = 256
#: Queries that an index answers in one batch; vectors that choose the number of probes.
MOST_QUERIES, JUDGES = 10_000, 64


def unit_rows(column, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows): the vectors of an Arrow list column to unit length, without a Python object for each.

    Null, zero, empty and non-finite vectors, and those whose squares overflow, are left out, as are those of another length than ``dims`` (of the first, where it is None).
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dims = dims or next((int(s) for s in size if s), 0)
    at = np.flatnonzero(size == dims) if dims else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros((0, dims))
    rows = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(rows, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        return at[ok], rows[ok] / norm[ok][:, None]


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * rows @ centres.T))


def sample(vectors: DataFrame, rows: int, most: int, id_col: str, salt: int = 0) -> DataFrame:
    """``most`` of ``rows`` rows, the same in every run: about twice as many pass by a hash of the identifier, so little is sorted."""
    part = min(1.0, 2 * most / max(rows, 1))
    h = F.xxhash64(id_col, F.lit(salt))
    return vectors.where(F.pmod(h, F.lit(1 << 40)) <= int(part * (1 << 40))).orderBy(h, id_col).limit(most)


def learn(vectors: DataFrame, rows: int, cells: int, id_col: str = "id", vector: str = "vec") -> np.ndarray:
    """At most ``cells`` centres from a sample of SAMPLE of the ``rows`` rows."""
    some = sample(vectors.where(F.col(vector).isNotNull()), rows, SAMPLE, id_col).select(F.col(vector).cast("array<double>").alias("vec")).toArrow()
    _, rows = unit_rows(some["vec"])
    rows = np.unique(rows, axis=0)
    if not len(rows):
        return np.zeros((0, 0))
    rng = np.random.default_rng(7)
    # Each next centre is drawn with the weight of its squared distance to those before it, so small far groups get one too.
    first, near = [int(rng.integers(len(rows)))], np.full(len(rows), np.inf)
    while len(first) < min(cells, MOST_CELLS, len(rows)):
        near = np.minimum(near, ((rows - rows[first[-1]]) ** 2).sum(1))
        if near.sum() <= 0:
            break
        first.append(int(rng.choice(len(rows), p=near / near.sum())))
    centres = rows[first]
    for _ in range(ROUNDS):
        own = distances(rows, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, id_col: str = "id", vector: str = "vec") -> DataFrame:
    """id, vec, cell (of the nearest centre), dist (to it)."""
    spark = vectors.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most
    dims = centres.shape[1]

    def run(batches):
        for batch in batches:
            at, rows = unit_rows(batch.column("vec"), dims)
            for k in range(0, len(at), STRIP):
                d = distances(rows[k : k + STRIP], shared.value)
                cell = d.argmin(1)
                kept = batch.take(pa.array(at[k : k + STRIP], pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], names=["id", "vec", "cell", "dist"])

    own = vectors.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    if not len(centres):
        return spark.createDataFrame([], "id long, vec array<double>, cell int, dist double")
    return own.mapInArrow(run, "id long, vec array<double>, cell int, dist double")


@dataclass(frozen=True)
class Meeting:
    """Which rows meet: own rows (id, vec, cell), guests of other cells (id, vec, cell), and by cell how many there are of each."""

    own: DataFrame
    guests: DataFrame
    homes: dict[int, int]
    visits: dict[int, int]

    @property
    def possible(self) -> int:
        n = sum(self.homes.values())
        return n * (n - 1) // 2

    @property
    def compared(self) -> int:
        return sum(n * (n - 1) // 2 for n in self.homes.values()) + sum(n * self.homes[c] for c, n in self.visits.items())

    @property
    def skipped(self) -> float:
        """The share of all pairs that the bound rules out unseen."""
        return 1 - self.compared / self.possible if self.possible else 0.0


def meeting(vectors: DataFrame, above: float, cells: int | None = None, id_col: str = "id", vector: str = "vec") -> Meeting:
    """Cells for pairs with cosine > above.

    A vector x of cell i is a guest of cell j only if a vector y of j can be within e = sqrt(2 - 2 above) of it:
    then d(x, j) <= j's radius + e, and, as y lies on j's side of the plane between the two centres, x is no farther
    than e from that plane: (d(x, j)^2 - d(x, i)^2) / (2 d(i, j)) <= e. Of two cells one sends guests to the other, so a pair meets once.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * above))) + 1e-6
    rows = vectors.count()
    centres = learn(vectors, rows, cells or max(1, int(np.ceil(np.sqrt(rows)))), id_col, vector)
    own = stage(assign(vectors, centres, id_col, vector), "cells")
    # A row for each cell, MOST_CELLS at most.
    found = own.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()
    radius = np.full(len(centres), -np.inf)
    radius[[f.cell for f in found]] = [f.r for f in found]
    shared = own.sparkSession.sparkContext.broadcast((centres, radius))
    dims = centres.shape[1]

    def invite(batches):
        centre, far = shared.value
        number, between = np.arange(len(centre)), distances(centre, centre)
        for batch in batches:
            own, units = unit_rows(batch.column("vec"), dims)
            for s in range(0, len(own), STRIP):
                at = own[s : s + STRIP]
                home = batch.column("cell").to_numpy()[at]
                d = distances(units[s : s + STRIP], centre)
                ok = (d <= far[None, :] + reach) & (d**2 - d[np.arange(len(d)), home][:, None] ** 2 <= 2 * between[home] * reach + 1e-6)
                ok &= (home[:, None] < number[None, :]) == ((home[:, None] + number[None, :]) % 2 == 0)
                ok[np.arange(len(d)), home] = False
                x, y = np.nonzero(ok)
                for k in range(0, len(x), BLOCK):  # a strip can make many guests
                    part = batch.take(pa.array(at[x[k : k + BLOCK]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(y[k : k + BLOCK], pa.int32())], names=["id", "vec", "cell"])

    guests = own.select("id", "vec", "cell").mapInArrow(invite, "id long, vec array<double>, cell int")
    visits = guests.groupBy("cell").count().collect()
    return Meeting(own.select("id", "vec", "cell"), guests, {f.cell: f.n for f in found}, {v["cell"]: v["count"] for v in visits})


def similar_pairs(vectors: DataFrame, above: float, blocks: int | None = None, id_col: str = "id", vector: str = "vec") -> DataFrame:
    """All pairs a < b with cosine > above: a, b, sim. ``blocks`` is the number of cells.

    Exact: cells that can't hold a similar pair never meet (see ``meeting``). A cell's rows and its guests are cut into
    blocks of about 4,096 rows, and two blocks are multiplied in a task of their own, so a cell with a third
    of all rows is spread out as well. Vectors that ``unit_rows`` leaves out, and null identifiers, are in no pair; nor are vectors of
    another length than the first of the sample. Repeated rows of one identifier pair with others each, but not with each other.
    """
    m = meeting(vectors, above, blocks, id_col, vector)
    spark = vectors.sparkSession
    parts = lambda n: -(-n // BLOCK)
    sizes = [(c, parts(n), parts(m.visits.get(c, 0))) for c, n in m.homes.items()]
    size = F.broadcast(spark.createDataFrame(sizes, "cell int, h int, g int"))  # MOST_CELLS rows at most
    nth = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = m.own.join(size, "cell").withColumn("k", nth("h"))
    inside = home.withColumn("o", F.explode(upto("h"))).select("id", "vec", "cell", F.lit(0).alias("kind"), F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") <= F.col("o")).alias("left"))
    hosts = home.where("g > 0").withColumn("i", F.explode(upto("g"))).select("id", "vec", "cell", F.lit(1).alias("kind"), "i", F.col("k").alias("j"), F.lit(False).alias("left"))
    guests = m.guests.join(size, "cell").withColumn("i", nth("g")).withColumn("j", F.explode(upto("h"))).select("id", "vec", "cell", F.lit(1).alias("kind"), "i", "j", F.lit(True).alias("left"))
    dealt = inside.unionByName(hosts).unionByName(guests)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        at, rows = unit_rows(table["vec"])
        ids, left = table["id"].to_numpy()[at], table["left"].to_numpy()[at]
        same = table["kind"][0].as_py() == 0 and table["i"][0].as_py() == table["j"][0].as_py()
        one, two = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        other = rows[two].T
        for s in range(0, len(one), STRIP):  # pairs leave as they are found, so a task holds no more than a strip's
            x, y = np.nonzero(rows[one[s : s + STRIP]] @ other > above)
            a, b = ids[one[s + x]], ids[two[y]]
            ok = a < b if same else a != b
            x, y, a, b = one[s + x[ok]], two[y[ok]], a[ok], b[ok]
            for k in range(0, len(a), 1 << 14):
                p = slice(k, k + (1 << 14))
                sim = (rows[x[p]] * rows[y[p]]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[p], b[p]), pa.int64()), pa.array(np.maximum(a[p], b[p]), pa.int64()), pa.array(sim)], names=["a", "b", "sim"])

    return dealt.groupBy("cell", "kind", "i", "j").applyInArrow(multiply, "a long, b long, sim double")


FOUND = "query_id long, id long, sim double"


@dataclass(frozen=True)
class VectorIndex:
    """SNK17: vectors in Parquet, a folder for each cell. ``probes``: how many cells a search reads for each query, chosen when it was made."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    radius: np.ndarray
    rows: dict[int, int]
    probes: int = 1

    def read(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: other folders aren't opened."""
        return self.spark.read.schema("id long, vec array<float>, dist double, cell int").parquet(self.path).where(F.col("cell").isin(cells))

    def share(self, cells) -> float:
        return sum(self.rows.get(int(c), 0) for c in cells) / max(1, sum(self.rows.values()))

    def order(self, units: np.ndarray) -> np.ndarray:
        """For each query the cells, nearest centre first."""
        return np.argsort(distances(units, self.centres), axis=1, kind="stable")

    def _compare(self, names, units: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """Up to k of each task for each query, of the cells that it wants (queries x cells)."""
        ship(self.spark)
        cells = np.flatnonzero(wanted.any(0)).tolist()
        dims = self.centres.shape[1]

        def run(batches):
            best: dict = {}
            for batch in batches:
                at, rows = unit_rows(batch.column("vec"), dims)
                ids, cell = batch.column("id").to_numpy()[at], batch.column("cell").to_numpy()[at]
                for c in np.unique(cell):
                    asked, own = np.flatnonzero(wanted[:, c]), cell == c
                    sims = np.round(units[asked] @ rows[own].T, 6)
                    for q, s in zip(asked.tolist(), sims):
                        top = np.lexsort((ids[own], -s))[:k]
                        best[q] = sorted([*best.get(q, []), *zip((-s[top]).tolist(), ids[own][top].tolist())])[:k]
            out = [(names[q], i, -s) for q, found in best.items() for s, i in found]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "sim"])

        return self.read(cells).select("id", "vec", "cell").mapInArrow(run, FOUND)

    def search(self, queries: list[tuple], k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, id, sim (6 places), rank from 1, ties by id, for (query_id, vector) pairs.

        Reads the ``probes`` cells nearest to each query. With ``exact`` it goes on to every cell whose centre less its
        radius is nearer than the k-th found (of a query with fewer than k, every cell): the k nearest of all rows.
        Zero, null and non-finite vectors, and those of another length, find nothing and aren't found.
        """
        from pyspark.sql import Window

        if len(queries) > MOST_QUERIES:
            raise ValueError(f"{len(queries)} queries are more than the {MOST_QUERIES} of a batch")
        at, units = unit_rows(pa.array([v for _, v in queries], pa.list_(pa.float64())), self.centres.shape[1] or None)
        if not len(at) or not self.rows:
            return self.spark.createDataFrame([], f"{FOUND}, rank int")
        names = [queries[i][0] for i in at]
        wanted = np.zeros((len(at), len(self.centres)), bool)
        np.put_along_axis(wanted, self.order(units)[:, : probes or self.probes], True, 1)
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ranked(self._compare(names, units, wanted, k))
        if not exact:
            return found
        found = stage(found, "nearest")
        # A number for each query of the batch.
        last = {r.query_id: r.sim for r in found.where(F.col("rank") == k).select("query_id", "sim").collect()}
        far = np.array([np.sqrt(max(0.0, 2 - 2 * (last[q] - 1e-6))) if q in last else np.inf for q in names])
        more = (distances(units, self.centres) - self.radius[None, :] <= far[:, None] + 1e-6) & ~wanted & np.isfinite(self.radius)[None, :]
        if not more.any():
            return found
        return ranked(found.select("query_id", "id", "sim").unionByName(self._compare(names, units, more, k)))


def vector_index(vectors: DataFrame, path: str | None = None, cells: int | None = None, k: int = 10, recall: float = 0.95, id_col: str = "id", vector: str = "vec") -> VectorIndex:
    """SNK17: an index that covers every row of vectors with a usable vector, written below ``path`` or for this session.

    Centres come from a bounded sample. The number of probes is the smallest with which JUDGES rows of the table, asked
    against all rows, find a share of ``recall`` of their k nearest; search with ``exact`` doesn't depend on it.
    """
    from .vectors import top_similar

    spark = vectors.sparkSession
    path = path or new_path(spark, "vectors")
    rows = vectors.count()
    centres = learn(vectors, rows, cells or max(1, int(np.ceil(np.sqrt(rows)))), id_col, vector)
    own = assign(vectors, centres, id_col, vector).withColumn("vec", F.col("vec").cast("array<float>"))
    # Files of a cell: as many as it would need if half of all rows fell into it, up to 64, so a hot cell isn't one task's.
    files = int(min(64, max(1, rows // (2 * FILE_ROWS))))
    own.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files))).write.partitionBy("cell").parquet(path)
    made = VectorIndex(spark, path, centres, np.full(len(centres), -np.inf), {})
    if not len(centres):
        return made
    written = made.read(list(range(len(centres))))
    found = written.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()
    radius = made.radius.copy()
    radius[[f.cell for f in found]] = [f.r for f in found]
    made = VectorIndex(spark, path, centres, radius, {f.cell: f.n for f in found})
    judges = [(r.id, r.vec) for r in sample(written, rows, JUDGES, "id", 1).select("id", "vec").collect()]
    truth = top_similar(written, judges, k).select("query_id", "id")
    where = truth.join(written.select("id", "cell"), "id").select("query_id", "cell").collect()  # JUDGES x k rows
    names = {q: n for n, (q, _) in enumerate(judges)}
    order = made.order(unit_rows(pa.array([v for _, v in judges], pa.list_(pa.float64())))[1])
    places = np.sort([int(np.flatnonzero(order[names[r.query_id]] == r.cell)[0]) + 1 for r in where])
    probes = int(places[max(0, int(np.ceil(recall * len(places))) - 1)]) if len(places) else len(centres)
    return VectorIndex(spark, path, centres, radius, made.rows, probes)
