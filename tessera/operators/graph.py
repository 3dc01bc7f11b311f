"""Entity graph: resolution, neighbourhoods, impact, components."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analysis_commit, entity_key
from ..functions.vocab import KNOWLEDGE_RELATIONS, KNOWLEDGE_TYPES, TUNING
from ..sources.io import discard, freed, stage
from .contain import clean, contained, gram_index

#: Entities asked about in one call: they are sent to every task.
MOST_ROOTS = 10_000
SAFE_TYPE = re.compile(r"[A-Z][A-Z_]*")


def few(roots: DataFrame) -> DataFrame:
    if roots.limit(MOST_ROOTS + 1).count() > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} entities in a call")
    return F.broadcast(roots)


def listed(roots: DataFrame) -> DataFrame:
    """Entities to be joined by their ids: sent to every task up to MOST_ROOTS, joined by a shuffle beyond."""
    return F.broadcast(roots) if roots.limit(MOST_ROOTS + 1).count() <= MOST_ROOTS else roots


def resolve(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (q) the entity that fits best: equal name, then a name that ends in -q, then one that has q.

    Among these a document-backed one, then the shortest name, then the id. Slash and dash are equal;
    wildcards are taken literally (K7). No row if nothing fits. Names and queries meet by trigrams.
    """
    q = few(asked.select("q", clean(entity_key(F.col("q"))).alias("qk")).where("qk != ''").distinct())
    named = entities.withColumn("nk", clean(entity_key(F.col("name"))))
    field = F.lit("name").alias("field")
    hit = contained(gram_index(named.select(field, F.col("nk").alias("text"))), q.select(field, F.col("qk").alias("needle")))
    hit = hit.select(F.col("text").alias("nk"), F.col("needle").alias("qk")).join(q, "qk").join(named, "nk")
    order = Window.partitionBy("q").orderBy(F.desc(F.col("nk") == F.col("qk")), F.desc(F.endswith("nk", F.concat(F.lit("-"), "qk"))), F.desc(F.col("document_id").isNotNull()), F.length("name"), "entity_id")
    return hit.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("q", "entity_id", "type", "name")


def safe_types(types: list[str]) -> list[str]:
    """Relation types are checked before they are used or stored."""
    for t in types:
        if not SAFE_TYPE.fullmatch(t):
            raise ValueError(f"not a relation type: {t!r}")
    return types


def numbered(roots: DataFrame) -> DataFrame:
    """root, block, bit: the distinct roots in blocks of at most 64, numbered without one global order (ranges of some thousand, ordered inside).

    Neighbours by name (shorter ones first) share a block, as they often share nodes. To be written: ranges come from a sample.
    """
    own = roots.select(F.col("entity_id").alias("root")).where("root IS NOT NULL").distinct()
    size = F.length(F.col("root").cast("string"))
    ranges = own.repartitionByRange(own.count() // 4096 + 1, size, "root").sortWithinPartitions(size, "root")
    n = ranges.withColumn("n", F.monotonically_increasing_id()).select("root", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("n"))
    return n.select("root", (F.col("part") * (1 << 26) + F.floor(F.col("n") / 64)).alias("block"), (F.col("n") % 64).alias("bit"))


def _reached(edges: DataFrame, roots: DataFrame, hops: int, types: list[str] | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Edges by block of roots with a mask for each distance, the numbered roots, and the masks' names.

    A search from many roots at once: 64 roots share a row of (node, block), one bit each, so a hop carries an
    edge once for a block instead of once for a root, and bits are or-ed before they travel. Each round drops the
    bits seen before, so no path is walked twice. A mask holds the roots of which the edge is that far, and not nearer.
    """
    own = edges.where(F.col("type").isin(*safe_types(types))) if types else edges
    # Written: every hop and both ends read them.
    own = stage(own.select("src", "dst", "type").distinct(), "edges")
    named = stage(numbered(roots), "roots")
    both = own.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(own.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    frontier = named.groupBy(F.col("root").alias("node"), "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("m"))
    levels = [frontier]
    for _ in range(1, hops):
        step = frontier.join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node"), "block").agg(F.bit_or("m").alias("m"))
        old = functools.reduce(DataFrame.unionByName, levels).groupBy("node", "block").agg(F.bit_or("m").alias("old"))
        fresh = step.join(old, ["node", "block"], "left").select("node", "block", F.expr("m & ~coalesce(old, 0L)").alias("m"))
        frontier = stage(fresh.where("m != 0"), "frontier")
        levels.append(frontier)
    names = [f"m{d}" for d in range(hops)]
    apart = [level.select("node", "block", *(F.col("m").alias(n) if n == f"m{d}" else F.lit(0).cast("long").alias(n) for n in names)) for d, level in enumerate(levels)]
    at = functools.reduce(DataFrame.unionByName, apart).groupBy("node", "block").agg(*(F.bit_or(n).alias(n) for n in names))
    ends = own.join(at, F.col("src") == F.col("node")).unionByName(own.join(at, F.col("dst") == F.col("node"))).drop("node")
    ends = ends.groupBy("src", "dst", "type", "block").agg(*(F.bit_or(n).alias(n) for n in names))
    nearer = lambda d: " | ".join(names[:d]) or "0L"
    return ends.select("src", "dst", "type", "block", *[F.expr(f"{n} & ~({nearer(d)})").alias(n) for d, n in enumerate(names)]), named, names


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int = 1, types: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Edges (root, src, dst, type, distance) with an endpoint within hops - 1 of a root, directions ignored.

    Roots become rows again at the end, without a further exchange; so there are as many rows as roots reach edges.
    ``cap`` keeps the nearest edges of each root in order (T10). Repeated edges and roots count once.
    """
    ends, named, names = _reached(edges, roots, min(max(int(hops), 1), TUNING.hops), types)
    has = [F.expr(f"shiftrightunsigned({n}, bit) & 1L") == 1 for n in names]
    distance = functools.reduce(lambda far, d: F.when(has[d], F.lit(d)).otherwise(far), reversed(range(len(names))), F.lit(None).cast("int"))
    hit = functools.reduce(lambda x, y: x | y, has)
    out = ends.join(listed(named.withColumnRenamed("block", "_b")), (F.col("block") == F.col("_b")) & hit).select("root", "src", "dst", "type", distance.alias("distance"))
    if cap:
        order = Window.partitionBy("root").orderBy("distance", "src", "type", "dst")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    return out


#: Masks of 64 roots in a row of ``neighbourhood_counts``.
WORDS = 8
MASKS = [f"m{w}" for w in range(WORDS)]
#: Nodes with more edges than HUB are hubs to ``neighbourhood_counts``; MOST_HUBS at most, those with the most edges (they are sent to every task).
HUB, MOST_HUBS = 1024, 256
#: Nodes of 8 blocks of roots whose lists one task opens.
OPENED = 65_536


def _lists(pairs: DataFrame) -> DataFrame:
    """Written lists (node, type, others, halves) of pairs (node, type, other) that lie together by node, 4,096 to a list at most; halves counts the edges without another end."""
    part = F.shiftright(F.monotonically_increasing_id(), 12).alias("part")
    rows = pairs.sortWithinPartitions("node", "type").select("node", "type", "other", part)
    return stage(rows.groupBy("node", "type", "part").agg(F.collect_list("other").alias("others"), F.count_if(F.col("other").isNull()).alias("halves")).drop("part"), "edges")


def _any(names: list[str]) -> str:
    return f"({' | '.join(names)}) != 0"


def _or(rows: DataFrame, *keys: str, names: list[str] = MASKS) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.bit_or(m).alias(m) for m in names])


def _bits(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of c over rows (keys, c, block, masks), for each of the 64 bits of each mask: (keys, block, w, b0 to b63)."""
    each = rows.select(*keys, "c", "block", F.posexplode(F.array(*MASKS)).alias("w", "m")).where("m != 0")
    return each.groupBy(*keys, "block", "w").agg(*[F.sum(F.expr(f"(shiftrightunsigned(m, {b}) & 1L) * c")).alias(f"b{b}") for b in range(64)])


def _of_roots(bits: DataFrame, named: DataFrame) -> DataFrame:
    """(root, type, n) of sums by bit."""
    each = bits.groupBy("type", "block", "w").agg(*[F.sum(f"b{b}").alias(f"b{b}") for b in range(64)]).withColumn("block", F.col("block") * WORDS + F.col("w"))
    each = each.select("type", "block", F.posexplode(F.array(*[f"b{b}" for b in range(64)])).alias("bit", "n")).where("n != 0")
    return each.join(named, ["block", "bit"]).select("root", "type", "n")


def neighbourhood_counts(edges: DataFrame, roots: DataFrame, hops: int = 1, types: list[str] | None = None) -> DataFrame:
    """(root, type, n): how many edges of each type a root's neighbourhood has. No row is made for an edge and a root, or a block of roots.

    Counted from the nodes' degrees. Let D(d) be the sum of the degrees of the nodes that are d hops away, and S(d)
    the number of edges with both ends there. Every edge leads to the same hop or the next, so the edges of h hops are
    D(h-1) + D(h-3) + ... - S(h-1) + S(h-2) - ... S(d) needs the edges whose two ends some roots have d hops away. Where all
    cycles are even, there are none.

    The nodes one hop away are rows (node, block) with a mask for 512 roots. Those two hops away can be as many as roots times nodes, where
    hubs lie between; so a node has rows there only for the blocks that reach it otherwise. What hubs alone reach is
    the same for all roots, and all nodes, that have the same hubs beside them: it is counted once for such a class, and the rows
    hold what is to be added (sign 1) or taken away (-1, nearer nodes).
    """
    hops = min(max(int(hops), 1), TUNING.hops)
    with freed(edges.sparkSession):
        return _counts(edges.where(F.col("type").isin(*safe_types(types))) if types else edges, roots, hops)


def _counts(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    # An edge is made distinct where its target is, and lies there; an edge without an end lies at the other one.
    ends = edges.select(F.coalesce("dst", "src").alias("node"), "type", F.when(F.col("dst").isNotNull(), F.col("src")).alias("other"), F.col("dst").isNull().alias("open"))
    into = _lists(ends.where("node IS NOT NULL").repartition("node").distinct())
    out = _lists(into.select(F.explode("others").alias("node"), "type", F.col("node").alias("other")).repartition("node"))
    links = into.unionByName(out)
    sized = into.select("node", "type", F.size("others").alias("n_in"), F.lit(0).alias("n_out"), "halves").unionByName(out.select("node", "type", F.lit(0).alias("n_in"), F.size("others").alias("n_out"), "halves"))
    degrees = stage(sized.groupBy("node", "type").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sum("halves").alias("halves")), "degrees")

    named = stage(numbered(roots), "roots")
    spot = named.select(F.col("root").alias("node"), F.floor(F.col("block") / WORDS).alias("block"), (F.col("block") % WORDS * 64 + F.col("bit")).cast("int").alias("bit"))
    masks = [F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit & 63)")).otherwise(F.lit(0).cast("long")).alias(m) for w, m in enumerate(MASKS)]
    levels = [stage(spot.select("node", "block", *masks), "frontier")]
    if hops > 1:
        # Roots travel by their numbers, and become masks where they meet.
        met = links.join(spot, "node").select(F.explode("others").alias("node"), "block", "bit").repartition("node").select("node", "block", *masks)
        levels.append(stage(_less(_or(met, "node", "block"), levels[:1]), "frontier"))
    at = functools.reduce(DataFrame.unionByName, [level.select("node", F.lit(d).alias("d"), "block", F.lit(1).alias("sign"), *MASKS) for d, level in enumerate(levels)])
    hubs = None
    if hops > 2:
        hubs = _hubs(links, degrees, named, levels[1])
        at = at.unionByName(_two_away((into, out), levels, hubs).select("node", F.lit(2).alias("d"), "block", "sign", *MASKS))

    discard(out)

    # An edge with a null end leads nowhere, so it counts at every hop.
    whole = F.when((hops - F.col("d")) % 2 == 1, F.col("n_in") + F.col("n_out")).otherwise(0) + F.col("halves")
    sums = stage(_bits(at.join(degrees, "node").select("type", (F.col("sign") * whole).alias("c"), "block", *MASKS).where("c != 0"), "type"), "bits")
    flat = _flat(into, degrees, at, hubs, hops)
    discard(into)
    ends = F.when(F.col("few_dst"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))).otherwise(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")))
    both = flat.where("size(same) > 0").select("type", ends.alias("e"), F.explode("same").alias("d")).select("type", "d", "e.*")
    both = both.join(at, ["node", "d"]).select("type", "d", "other", "block", F.col("sign").alias("_sign"), *[F.col(m).alias(f"_{m}") for m in MASKS]).join(at.withColumnRenamed("node", "other"), ["other", "d", "block"])
    c = F.col("sign") * F.col("_sign") * F.when((hops - 1 - F.col("d")) % 2 == 0, -1).otherwise(1)
    sums = sums.unionByName(stage(_bits(both.select("type", c.alias("c"), "block", *[F.expr(f"{m} & _{m}").alias(m) for m in MASKS]), "type"), "bits"))
    if not hubs:
        return _of_roots(sums, named).where("n > 0")

    # Edges from the rows' nodes to what hubs reach: their bits are counted by class before they meet the class's mask.
    cross = flat.where("src_rows AND dst_class IS NOT NULL").select("type", F.col("src").alias("node"), F.col("dst_class").alias("class"))
    cross = cross.unionByName(flat.where("dst_rows AND src_class IS NOT NULL").select("type", F.col("dst").alias("node"), F.col("src_class").alias("class")))
    crossed = stage(_bits(cross.join(at.where("d = 2"), "node").select("type", "class", (-F.col("sign")).alias("c"), "block", *MASKS), "type", "class"), "crossed")
    mask = F.array(*MASKS)[F.col("w")]
    kept = crossed.join(_reach(hubs, crossed.select("class", "block").distinct()), ["class", "block"])
    sums = sums.unionByName(kept.select("type", "block", "w", *[F.when(F.shiftrightunsigned(mask, b).bitwiseAND(1) == 1, F.col(f"b{b}")).otherwise(0).alias(f"b{b}") for b in range(64)]))

    of_class = hubs["members"].join(degrees, "node").groupBy("class", "type").agg(F.sum(F.expr("n_in + n_out + halves")).alias("c"))
    once = of_class.join(hubs["masks"], "class").select("type", "c", "block", *MASKS)
    inside = flat.where("src_class IS NOT NULL AND dst_class IS NOT NULL").groupBy("type", "src_class", "dst_class").agg((-F.count("*")).alias("c"))
    inside = inside.join(hubs["masks"].withColumnRenamed("class", "src_class"), "src_class").withColumnsRenamed({m: f"_{m}" for m in MASKS}).join(hubs["masks"].withColumnRenamed("class", "dst_class"), ["dst_class", "block"])
    once = once.unionByName(inside.select("type", "c", "block", *[F.expr(f"{m} & _{m}").alias(m) for m in MASKS]))
    shared = _of_roots(stage(_bits(once, "type"), "bits"), hubs["classes"]).withColumnRenamed("root", "class").join(hubs["of_roots"], "class").select("root", "type", "n")
    return _of_roots(sums, named).unionByName(shared).groupBy("root", "type").agg(F.sum("n").alias("n")).where("n > 0")


def _less(step: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The rows (node, block, masks) of a step without the bits of the levels before."""
    old = _or(functools.reduce(DataFrame.unionByName, levels), "node", "block").withColumnsRenamed({m: f"old_{m}" for m in MASKS})
    return step.join(old, ["node", "block"], "left").select("node", "block", *[F.expr(f"{m} & ~coalesce(old_{m}, 0L)").alias(m) for m in MASKS]).where(_any(MASKS))


def _hubs(links: DataFrame, degrees: DataFrame, named: DataFrame, near: DataFrame) -> dict[str, DataFrame] | None:
    """Nodes by the set of hubs beside them, themselves aside; None without a hub.

    nodes: the hubs; members: (node, class); sets: (class, hub); rows: the hubs' masks of roots by block; classes and
    of_roots: the classes of roots, numbered as roots are, and each root's; masks: which of these classes a class has a hub with.
    """
    total = F.sum(F.expr("n_in + n_out"))
    nodes = stage(degrees.groupBy("node").agg(total.alias("c")).where(F.col("c") > HUB).orderBy(F.desc("c"), "node").limit(MOST_HUBS).select("node"), "hubs")
    if not nodes.limit(1).count():
        return None
    beside = links.join(F.broadcast(nodes), "node").select(F.col("node").alias("hub"), F.explode("others").alias("node")).where("node != hub")
    sets = stage(beside.groupBy("node").agg(F.array_sort(F.collect_set("hub")).alias("hubs")), "members")
    kinds = stage(sets.select("hubs").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    members = stage(sets.join(kinds, "hubs").select("node", "class"), "members")
    of_roots = stage(named.join(members, F.col("root") == F.col("node")).select("root", "class"), "members")
    classes = stage(numbered(of_roots.select(F.col("class").alias("entity_id"))), "classes")
    one = kinds.select("class", F.explode("hubs").alias("hub"))
    word = F.col("block") % WORDS
    marked = classes.select(F.col("root").alias("class"), F.floor(F.col("block") / WORDS).alias("block"), *[F.when(word == w, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long")).alias(m) for w, m in enumerate(MASKS)])
    hit = _or(marked.join(one, "class"), "hub", "block")
    masks = stage(_or(one.join(hit, "hub"), "class", "block"), "masks")
    rows = stage(near.join(F.broadcast(nodes), "node").withColumnRenamed("node", "hub"), "masks")
    return {"nodes": nodes, "members": members, "sets": one, "rows": rows, "classes": classes, "of_roots": of_roots, "masks": masks}


def _reach(hubs: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """The masks of the roots that have a hub in common with a class, for pairs (class, block)."""
    return _or(pairs.join(hubs["sets"], "class").join(hubs["rows"], ["hub", "block"]), "class", "block")


def _two_away(lists: tuple[DataFrame, ...], levels: list[DataFrame], hubs: dict[str, DataFrame] | None) -> DataFrame:
    """Rows (node, block, sign, masks): nodes two hops away, as far as hubs don't reach them, and (sign -1) nearer nodes that hubs reach too.

    Nodes go with their lists to their blocks, 8 of them together, so what a block reaches is put together before it travels.
    """
    inner = levels[1].join(F.broadcast(hubs["nodes"]), "node", "left_anti") if hubs else levels[1]
    inner = inner.withColumn("wide", F.floor(F.col("block") / 8)).repartition("node").groupBy("node", "wide").agg(F.collect_list(F.struct("block", *MASKS)).alias("marks"))
    inner = stage(inner, "marks")
    salts = inner.groupBy("wide").agg((F.floor(F.count("*") / OPENED) + 1).alias("salts"))  # a row for 4,096 roots
    salted = inner.join(F.broadcast(salts), "wide").select("node", "wide", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "marks")
    steps = []
    for links in lists:
        opened = salted.join(links.select("node", "others"), "node").drop("node").repartition("wide", "salt")
        opened = opened.select("others", F.explode("marks").alias("x")).select(F.explode("others").alias("node"), "x.*")
        steps.append(stage(_or(opened, "node", "block"), "step"))
    step = functools.reduce(DataFrame.unionByName, steps)
    discard(inner)
    if not hubs:
        far = stage(_less(_or(step, "node", "block"), levels).select("node", "block", F.lit(1).alias("sign"), *MASKS), "far")
        discard(*steps)
        return far
    olds, reach = [f"old_{m}" for m in MASKS], [f"hub_{m}" for m in MASKS]
    none = [F.lit(0).cast("long").alias(n) for n in (*MASKS, *olds)]
    far = step.select("node", "block", *MASKS, *none[WORDS:])
    for level in levels:
        far = far.unionByName(level.select("node", "block", *none[:WORDS], *[F.col(m).alias(o) for m, o in zip(MASKS, olds, strict=True)]))
    far = _or(far, "node", "block", names=MASKS + olds).join(hubs["members"], "node", "left").where(f"class IS NOT NULL OR {_any(MASKS)}")
    far = stage(far, "reached")
    discard(*steps)
    wide = _reach(hubs, far.where("class IS NOT NULL").select("class", "block").distinct()).withColumnsRenamed(dict(zip(MASKS, reach, strict=True)))
    met = far.join(wide, ["class", "block"], "left")
    more = F.struct(F.lit(1).alias("sign"), *[F.expr(f"{m} & ~{o} & ~coalesce({h}, 0L)").alias(m) for m, o, h in zip(MASKS, olds, reach, strict=True)])
    less = F.struct(F.lit(-1).alias("sign"), *[F.expr(f"{o} & coalesce({h}, 0L)").alias(m) for m, o, h in zip(MASKS, olds, reach, strict=True)])
    rows = stage(met.select("node", "block", F.explode(F.array(more, less)).alias("x")).select("node", "block", "x.*").where(_any(MASKS)), "far")
    discard(far)
    return rows


def _flat(into: DataFrame, degrees: DataFrame, at: DataFrame, hubs: dict[str, DataFrame] | None, hops: int) -> DataFrame:
    """Edges that may have both ends equally far from a root, with what to look for: hops at which both have rows (same), classes, rows two hops away.

    A node's blocks are told by 64 bits of their hashes, so few edges are kept that share no block; of types that can't have such edges none is looked at.
    """
    bits = [f"b{d}" for d in range(hops)]
    known = at.groupBy("node").agg(F.count("*").alias("n"), *[F.coalesce(F.bit_or(F.when(F.col("d") == d, F.expr("shiftleft(1L, int(pmod(xxhash64(block), 64)))"))), F.lit(0)).alias(b) for d, b in enumerate(bits)])
    if hubs:
        known = known.join(hubs["members"], "node", "full").select("node", "class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *bits)])
    else:
        known = known.withColumn("class", F.lit(None).cast("long"))
    known = stage(known, "known")
    last = bits[-1]

    def worth(src, dst, of):
        same = [F.col(f"{src}_{b}").bitwiseAND(F.col(f"{dst}_{b}")) != 0 for b in bits]
        row = lambda end: F.col(f"{end}_{last}") != 0
        return functools.reduce(lambda x, y: x | y, [*same, of(src) & of(dst), row(src) & of(dst), row(dst) & of(src)])

    ends = degrees.join(known, "node")
    by_type = ends.groupBy("type").agg(*[
        x for end, n in (("s", "n_in"), ("t", "n_out"))
        for x in (*[F.coalesce(F.bit_or(F.when(F.col("n_out" if end == "s" else "n_in") > 0, F.col(b))), F.lit(0)).alias(f"{end}_{b}") for b in bits], F.max((F.col("n_out" if end == "s" else "n_in") > 0) & F.col("class").isNotNull()).alias(f"{end}_class"))
    ])
    by_type = by_type.where(worth("s", "t", lambda end: F.col(f"{end}_class"))).select(F.col("type").alias("_type"), *[f"s_{b}" for b in bits])
    of = lambda end: known.select(F.col("node").alias(end), F.col("class").alias(f"{end}_class"), F.col("n").alias(f"{end}_n"), *[F.col(b).alias(f"{end}_{b}") for b in bits])
    rows = into.join(F.broadcast(by_type), F.col("type").eqNullSafe(F.col("_type"))).select(F.col("node").alias("dst"), "type", "others", *[f"s_{b}" for b in bits]).join(of("dst"), "dst")
    rows = rows.select("type", F.explode("others").alias("src"), "dst", "dst_class", "dst_n", *[(F.col(f"dst_{b}").bitwiseAND(F.col(f"s_{b}")) if b != last else F.col(f"dst_{b}")).alias(f"dst_{b}") for b in bits])
    rows = rows.join(of("src"), "src").where(worth("src", "dst", lambda end: F.col(f"{end}_class").isNotNull()))
    same = F.array_compact(F.array(*[F.when(F.col(f"src_{b}").bitwiseAND(F.col(f"dst_{b}")) != 0, F.lit(d)) for d, b in enumerate(bits)])).alias("same")
    flat = stage(rows.select("type", "src", "dst", "src_class", "dst_class", same, (F.col("dst_n") < F.col("src_n")).alias("few_dst"), *[(F.col(f"{end}_{last}") != 0).alias(f"{end}_rows") for end in ("src", "dst")]), "flat")
    discard(known)
    return flat


def publishes(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """For each root and topic it publishes to, the other nodes that subscribe to it, sorted."""
    pubs = edges.where("type = 'PUBLISHES_TO'").join(listed(roots.select(F.col("entity_id").alias("src"))), "src").select(F.col("src").alias("entity_id"), F.col("dst").alias("topic")).distinct()
    # A topic's subscribers are collected once, not for each of its publishers.
    subs = edges.where("type = 'SUBSCRIBES_TO'").join(pubs.select(F.col("topic").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("dst").alias("topic")).agg(F.sort_array(F.collect_set("src")).alias("all"))
    each = pubs.join(subs, "topic", "left").withColumn("_c", F.coalesce(F.array_remove("all", F.col("entity_id")), F.array().cast("array<string>")))
    return each.select("entity_id", "topic", F.array_join("_c", ",").alias("consumers"), F.size("_c").cast("long").alias("n_consumers"))


def consumers(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(entity_id, consumer): the other nodes that subscribe to a topic of the root."""
    pubs = edges.where("type = 'PUBLISHES_TO'").join(listed(roots.select(F.col("entity_id").alias("src"))), "src").select(F.col("src").alias("entity_id"), F.col("dst").alias("topic"))
    subs = edges.where("type = 'SUBSCRIBES_TO'").select(F.col("dst").alias("topic"), F.col("src").alias("consumer"))
    return pubs.join(subs, "topic").where("consumer != entity_id").select("entity_id", "consumer").distinct()


def impact_knowledge(edges: DataFrame, entities: DataFrame, roots: DataFrame, cap: int | None = TUNING.knowledge_cap) -> DataFrame:
    """(root, source, type, name, summary, origin): what is known about the root and about the direct consumers of its topics.

    The first ``cap`` of each root go by id, the root's own before its consumers'. With a cap no row is made for a root and each
    of its consumers: what each topic's subscribers know first bounds the ids that can be among a root's first, and only what is
    within the bounds is carried to the topics and on to the roots.
    """
    own = roots.select(F.col("entity_id").alias("root")).distinct()
    pubs = edges.where("type = 'PUBLISHES_TO'").join(listed(own.select(F.col("root").alias("src"))), "src").select(F.col("src").alias("root"), F.col("dst").alias("topic"))
    pubs = stage(pubs.distinct(), "publishers")
    subs = edges.where("type = 'SUBSCRIBES_TO'").select(F.col("dst").alias("topic"), F.col("src").alias("source"))
    subs = stage(subs.join(pubs.select("topic").distinct(), "topic", "left_semi").distinct(), "subscribers")
    asked = own.select(F.col("root").alias("entity_id")).unionByName(subs.select(F.col("source").alias("entity_id"))).distinct()
    known = stage(attached_knowledge(edges, entities, asked, cap).withColumnRenamed("target", "source"), "known")  # no root takes more of one
    ids = known.select("source", "entity_id").distinct()
    if cap:
        least = ids.groupBy("source").agg(F.min("entity_id").alias("entity_id"))
        heads = subs.join(least, "source").groupBy("topic").agg(F.min(F.struct("entity_id", "source")).alias("head")).select("topic", "head.*")
        rank = F.dense_rank().over(Window.partitionBy("root").orderBy("entity_id", "source"))
        firsts = pubs.join(heads, "topic").where("source != root").select("root", "entity_id", "source").withColumn("_n", rank).where(F.col("_n") <= cap)
        # A root with fewer than cap heads has no bound, nor have its topics.
        bounds = firsts.groupBy("root").agg(F.max("_n").alias("_n"), F.max("entity_id").alias("bound")).where(F.col("_n") == cap).select("root", "bound")
        pubs = stage(pubs.join(bounds, "root", "left"), "bounds")
        tops = pubs.groupBy("topic").agg(F.when(F.count("bound") == F.count("*"), F.max("bound")).alias("bound"))
        within = subs.join(tops, "topic").join(ids, "source").where("bound IS NULL OR entity_id <= bound").select("topic", "source", "entity_id")
        far = pubs.join(within, "topic").where("source != root AND (bound IS NULL OR entity_id <= bound)")
    else:
        far = pubs.join(subs, "topic").where("source != root").select("root", "source").distinct().join(ids, "source")
    near = own.join(ids, F.col("root") == F.col("source")).select("root", "source", "entity_id", F.lit(0).alias("far"))
    targets = near.unionByName(far.select("root", "source", "entity_id", F.lit(1).alias("far")).distinct())
    out = targets.join(known, ["source", "entity_id"]).select("root", "source", "far", "entity_id", "type", "name", "summary", "origin")
    if cap:
        first = Window.partitionBy("root").orderBy("far", "entity_id", "source")
        out = out.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).drop("_n")
    return out.drop("far")


def freshness(entities: DataFrame, documents: DataFrame, roots: DataFrame) -> DataFrame:
    """When a root's document was last indexed, and the commit it was reconciled with; nulls without a document."""
    d = documents.select("document_id", "updated_at", analysis_commit(F.col("content")).alias("analysis_commit"))
    return entities.join(listed(roots.select("entity_id").distinct()), "entity_id", "left_semi").select("entity_id", "document_id").join(d, "document_id", "left").select("entity_id", "updated_at", "analysis_commit")


def related(edges: DataFrame, roots: DataFrame, relation: str, inbound: bool = False) -> DataFrame:
    """For each root the distinct nodes at the other end of its edges of one type, sorted."""
    own, other = ("dst", "src") if inbound else ("src", "dst")
    hit = edges.where(F.col("type") == relation).join(listed(roots.select(F.col("entity_id").alias(own))), own)
    return hit.groupBy(F.col(own).alias("entity_id")).agg(F.array_join(F.sort_array(F.collect_set(other)), ",").alias("names"))


def attached_knowledge(edges: DataFrame, entities: DataFrame, targets: DataFrame, cap: int | None = TUNING.knowledge_cap) -> DataFrame:
    """Semantic constraints, decisions and problems next to the targets, in either direction; the first ``cap`` of each target by id."""
    use = edges.where(F.col("type").isin(*KNOWLEDGE_RELATIONS))
    both = use.select(F.col("src").alias("o"), F.col("dst").alias("target")).unionByName(use.select(F.col("dst").alias("o"), F.col("src").alias("target")))
    known = entities.where(F.col("type").isin(*KNOWLEDGE_TYPES) & (F.col("kind") == "semantic"))
    hit = both.join(listed(targets.select(F.col("entity_id").alias("target"))), "target").distinct().join(known, F.col("o") == F.col("entity_id"))
    out = hit.select("target", "entity_id", "type", "name", "summary", "origin")
    if not cap:
        return out
    own = Window.partitionBy("target").orderBy("entity_id")
    return out.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap).drop("_n")


def project_nodes(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """G4, P16, J3, SNK7: graph nodes with kind (metadata, else note if it has a document, else placeholder) and origin."""
    d = documents.select("document_id", F.col("path").alias("doc_path"))
    kind = F.coalesce(F.col("metadata.kind"), F.when(F.col("document_id").isNotNull(), "note").otherwise("placeholder"))
    origin = F.when(F.col("doc_path").startswith("agents/"), "agent").when(F.col("doc_path").isNotNull(), "human").otherwise(F.col("metadata.origin"))
    return entities.join(d, "document_id", "left").select("entity_id", "type", "name", kind.alias("kind"), origin.alias("origin"), F.col("metadata.summary").alias("summary"))


def project_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """G4, SNK7: distinct (src, dst, type) whose two ends are entities; types are checked before they are stored."""
    ids = entities.select("entity_id").distinct()
    bad = relations.where(~F.coalesce(F.col("type").rlike(f"^(?:{SAFE_TYPE.pattern})$"), F.lit(False))).select(F.col("type").cast("string").alias("type")).limit(1).collect()
    safe_types([str(r.type) for r in bad])
    own = relations.select("src", "dst", "type").distinct()
    return own.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def changed_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """S4, SNK7: what turns the snapshot old into new: change (insert, update, delete) and the row, the old one for deletes. Equal rows aren't listed."""
    values = [c for c in new.columns if c not in key]
    o = old.select(*key, F.struct(F.lit(True).alias("here"), *values).alias("_old"))
    n = new.select(*key, F.struct(F.lit(True).alias("here"), *values).alias("_new"))
    both = o.join(n, key, "full")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    row = F.coalesce("_new", "_old")
    return both.withColumn("change", change).where("change IS NOT NULL").select("change", *key, *[row[c].alias(c) for c in values])


def apply_changes(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The next snapshot: changed and deleted rows go, inserted and changed ones come. Applying a change set again changes nothing."""
    kept = old.join(changes.select(*key), key, "left_anti")
    return kept.select(*old.columns).unionByName(changes.where("change != 'delete'").select(*old.columns))


def project(nodes: DataFrame, edges: DataFrame, entities: DataFrame, documents: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """G4, S4, SNK7: change sets that turn a projection (nodes, edges) into that of the entities and relations.

    Nodes of entities that went are deleted, with their edges (an edge stays only while both ends are entities).
    """
    fresh = project_nodes(entities, documents)
    return {"nodes": changed_rows(nodes, fresh, ["entity_id"]), "edges": changed_rows(edges, project_edges(relations, entities), ["src", "dst", "type"])}


def components(edges: DataFrame, write=stage, rounds: int = 60) -> DataFrame:
    """(node, comp) with comp the smallest node that can be reached over edges (a, b); nodes without another node are left out.

    Rounds of contraction: every node hangs under its smallest neighbour, follows that one's choice once,
    and the edges are carried over to what the nodes hang under, so a round that starts with stars ends
    without edges. In every second round "smallest" goes by a hash, else a long path in the order of its
    names would lose a few nodes a round; so the rounds grow with the logarithm of the nodes.
    ``write`` puts a round's choices and edges where all executors read them and returns them read back:
    lineage stays short, a lost executor costs no round, and joins with a hub can be split. Only a yes or
    no comes to the driver. Self-loops and repeated edges do no harm.
    """
    once = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    own = write(edges.where("a != b").select(*once("a", "b")))  # an edge is kept in one direction
    labels, hashed = None, False
    for r in range(rounds):
        hashed |= r % 2 == 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(r)) if r % 2 else F.lit(0), F.col(c).alias("v"))
        least = F.least(F.min(rank("b")), rank("a"))["v"]
        chosen = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(least.alias("p")).withColumnRenamed("a", "node")
        hung = write(chosen.join(chosen.select(F.col("node").alias("p"), F.col("p").alias("q")), "p").select("node", F.col("q").alias("p")))
        labels = hung.withColumnRenamed("p", "comp") if labels is None else labels.join(hung.select(F.col("node").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        up = lambda c: hung.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))
        own = write(own.join(up("a"), "a").join(up("b"), "b").where("pa != pb").select(*once("pa", "pb")).distinct())
        if not own.limit(1).count():
            break
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    if hashed:
        labels = write(labels)
        named = labels.groupBy("comp").agg(F.min("node").alias("least"))
        labels = labels.join(named, "comp").select("node", F.col("least").alias("comp"))
    return labels
