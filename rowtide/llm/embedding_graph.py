"""Near-duplicate vectors by NN-descent.

Equal vectors are one point with a count.  Each point keeps a list of its ``k`` best
known neighbours.

* Start: the points are sorted, ``orders`` times, by random hyperplanes (signs, then
  one projection), and compared within windows that overlap.  A sort by range deals any
  crowd over as many tasks as it needs.
* Rounds: at every point its neighbours and those that have it as a neighbour are
  compared with each other, which are the neighbours of neighbours; what beats the last
  of a list gets in.  Points that very many have as a neighbour are dealt in parts, so
  none is left out.  Vectors travel as eight-bit integers here.
* A list that is full of links is saturated: there may be more than it holds.  So lists
  are enlarged to the whole loose component (links of ``threshold`` less ``slack``): all
  its members are compared, in double precision, in blocks where there are many.  Only
  this decides on links, counts them, and gives out a spanning star of each block.
* Audit: ``audit`` points, drawn by hash, are compared with all points.  As long as under
  ``recall`` of their links lie within components, the lists have settled too early:
  they become twice as long, get what one more order finds, and rounds go on.
  ``Graph.recalls`` has what was measured.

Work in a crowd of m vectors that are all linked grows with m^2 (their counts are asked
for), in tasks of two blocks; what is shuffled grows with m^2 over ``block``.

Defined results: a vector that is null, empty or zero, or holds a null or a non-finite
value, is linked with nothing and is its own component; vectors of different lengths are
not linked; equal ones are, whatever their ids; repeated rows count as vectors of their
own; a null vec_id is never the name of a component (null if it has no other) and is
kept only then; an empty table gives an empty one; columns but vec_id and embedding are
ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import cut
from rowtide.llm.simhash import components, stars

WINDOW, OVERLAP = 256, 32
#: Neighbours of one part at a point; a part is met by the point's whole list.
PART = 48


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """The vectors, all of length ``dim``, as rows of length one, in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def units(batch: Any) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) of each vector length in a batch."""
    column = batch.column("vec")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dims = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield at, unit(column.take(pa.array(at)), d)


# --- points -------------------------------------------------------------------------


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def named(table: DataFrame) -> DataFrame:
    """vec_id, embedding, and two hashes that name the vector; null where it is not usable."""
    v = F.col("embedding")
    ok = usable(v)
    return table.select("vec_id", "embedding", F.when(ok, F.xxhash64(v)).alias("k1"), F.when(ok, F.xxhash64(F.lit(7), v)).alias("k2"))


def distinct_points(rows: DataFrame) -> DataFrame:
    """node, vec, its hashes, n (equal vectors) and first (least vec_id), written to the shared folder."""
    one = rows.where("k1 is not null").groupBy("k1", "k2")
    held = one.agg(F.any_value("embedding").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return cut(held.withColumn("node", F.monotonically_increasing_id()))


# --- lists --------------------------------------------------------------------------


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """node, list: the k best (s, v) of each u of ``edges`` (u, v, s)."""
    ranked = F.sort_array(F.collect_set(F.struct("s", "v")), asc=False)
    return edges.groupBy(F.col("u").alias("node")).agg(F.slice(ranked, 1, k).alias("list"))


def windows(points: DataFrame, order: int, bits: int, k: int, least: float, seed: int) -> DataFrame:
    """Edges (u, v, s): the k best of each point within its windows of one order, and a star of each window's links."""
    kind = dict(points.dtypes)["vec"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in units(batch):
                planes = np.random.default_rng((seed, order, x.shape[1])).standard_normal((bits + 1, x.shape[1]))
                y = x @ planes.T
                sign = ((y[:, :bits] > 0) << np.arange(bits, dtype=np.int64)).sum(axis=1, dtype=np.int64)
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(own), batch.column("vec").take(own), pa.array(np.full(len(at), x.shape[1])), pa.array(sign), pa.array(y[:, bits])], ["node", "vec", "dim", "sign", "way"]
                )

    def compare(node: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = x @ x.T
        np.fill_diagonal(s, -2)
        near = min(k, len(node) - 1)
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        u, v = np.repeat(np.arange(len(node)), near), top.reshape(-1)
        a, b = np.nonzero(np.triu(s >= least))
        root = stars(len(node), a, b)
        tied = np.flatnonzero((root != np.arange(len(node))) & (s[np.arange(len(node)), root] >= least))
        u, v = np.concatenate([u, tied]), np.concatenate([v, root[tied]])
        yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v]), pa.array(s[u, v].astype(np.float32))], ["u", "v", "s"])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, x, fresh = np.zeros(0, np.int64), np.zeros((0, 0)), False
        for batch in batches:
            for at, own in units(batch):  # sorted by length, so one stretch for each
                if own.shape[1] != x.shape[1]:
                    if fresh and len(node) > 1:
                        yield from compare(node, x)
                    node, x = np.zeros(0, np.int64), np.zeros((0, own.shape[1]))
                node, x = np.concatenate([node, batch.column("node").to_numpy()[at]]), np.concatenate([x, own])
                fresh = True
                while len(node) >= WINDOW:
                    yield from compare(node[:WINDOW], x[:WINDOW])
                    node, x = node[WINDOW - OVERLAP :], x[WINDOW - OVERLAP :]
                    fresh = len(node) > OVERLAP
        if fresh and len(node) > 1:
            yield from compare(node, x)

    placed = points.mapInArrow(place, f"node long, vec {kind}, dim long, sign long, way double")
    dealt = placed.repartitionByRange("dim", "sign", "way").sortWithinPartitions("dim", "sign", "way")
    return dealt.select("node", "vec").mapInArrow(slide, "u long, v long, s float")


def small(points: DataFrame) -> DataFrame:
    """node, q and scale: unit vectors in eight bits a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in units(batch):
                scale = np.abs(x).max(axis=1) / 127
                q = np.rint(x / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale.astype(np.float32))], ["node", "q", "scale"])

    return points.select("node", "vec").mapInArrow(run, "node long, q binary, scale float")


def descend(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Edges (u, v, s) of one round that beat the last of u's list."""
    flat = lists.select("node", F.explode("list.v").alias("v"))
    crowded = flat.groupBy(F.col("v").alias("at")).agg(F.ceil(F.count("*") / max(PART, 2 * k)).cast("int").alias("parts")).where("parts > 1")
    crowded = cut(crowded)
    forward = flat.join(crowded, F.col("node") == F.col("at"), "left").select(F.col("node").alias("x"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("v").alias("member"))
    behind = flat.join(crowded, F.col("v") == F.col("at"), "left").select(F.col("v").alias("x"), F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("node").alias("member"))
    least = lists.select("node", F.when(F.size("list") < k, -2.0).otherwise(F.col("list")[k - 1]["s"]).cast("float").alias("least"))
    known = vectors.join(least, "node")
    members = forward.union(behind).distinct().join(known, F.col("member") == F.col("node")).drop("node")
    buckets = max(1, lists.count() * 2 * k // 200_000)
    shuffled = members.withColumn("bucket", F.pmod(F.xxhash64("x", "part"), F.lit(buckets)))

    def meet(table: pa.Table) -> pa.Table:
        x, part, member, floor, scale = (table.column(c).to_numpy() for c in ("x", "part", "member", "least", "scale"))
        q = table.column("q").combine_chunks()
        width = q.value_lengths().to_numpy(zero_copy_only=False) if hasattr(q, "value_lengths") else np.array([len(v.as_py()) for v in q])
        order = np.lexsort((part, x))
        first = np.flatnonzero((np.diff(x[order], prepend=x[order][0] - 1) != 0) | (np.diff(part[order], prepend=-1) != 0)) if len(x) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(x)))
        out = []
        for m in np.unique(size[size > 1]).tolist():
            groups = order[first[size == m][:, None] + np.arange(m)]
            dims = width[groups[:, 0]]
            for d in np.unique(dims).tolist():
                own = groups[dims == d]
                step = max(1, (1 << 21) // (m * max(m, d)))
                for g in (own[i : i + step] for i in range(0, len(own), step)):
                    v = np.frombuffer(b"".join(q.take(pa.array(g.reshape(-1))).to_pylist()), np.int8).reshape(len(g), m, d).astype(np.float32) * scale[g][..., None]
                    s = v @ v.transpose(0, 2, 1)
                    s[:, np.arange(m), np.arange(m)] = -2
                    if m > k + 1:  # no more than k of a group can stay in a list
                        s[s < -np.partition(-s, k - 1, axis=2)[:, :, k - 1 : k]] = -2
                    i, a, b = np.nonzero(s > floor[g][..., None])
                    out.append((member[g[i, a]], member[g[i, b]], s[i, a, b]))
        u, v, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        ok = s > -2
        return pa.table({"u": pa.array(u[ok]), "v": pa.array(v[ok]), "s": pa.array(s[ok], pa.float32())})

    return shuffled.groupBy("bucket").applyInArrow(meet, "u long, v long, s float")


# --- links --------------------------------------------------------------------------


def enlarged(groups: DataFrame, least: float, block: int) -> DataFrame:
    """a, b, links: of all members of each component the number of links, and edges (a, b) that span them.

    ``groups`` has node, root, vec and n.  Components of over ``block`` members are cut
    into blocks, and each two blocks are one task; small ones share tasks.
    """
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("m")))
    few = sizes.where(F.col("m") <= block).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    cuts = F.ceil(F.col("m") / block).cast("int")
    members = groups.join(sizes.select("root", cuts.alias("blocks")), "root")
    mine, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = members.withColumn("mine", mine).withColumn("other", F.explode(every))
    bucket = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(max(1, -(-few // block))))).otherwise(F.col("root"))
    dealt = spread.select("node", "root", "vec", "n", "mine", "blocks", bucket.alias("bucket"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def check(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        node, root, n, mine = (table.column(c).to_numpy() for c in ("node", "root", "n", "mine"))
        out_a, out_b, out_n = [], [], []
        for rows, x in units(table):
            order = np.argsort(root[rows], kind="stable")
            rows, x = rows[order], x[order]
            edge = np.append(np.flatnonzero(np.diff(root[rows], prepend=root[rows][0] - 1)), len(rows))
            for one, end in zip(edge, edge[1:]):
                own, y = rows[one:end], x[one:end]
                left = np.flatnonzero(mine[own] == low)
                right = left if low == high else np.flatnonzero(mine[own] == high)
                links, label = np.zeros(len(own), np.int64), np.arange(len(own))
                for at in range(0, len(left), 512):
                    part = left[at : at + 512]
                    linked = y[part] @ y[right].T >= least
                    if low == high:
                        linked[np.arange(len(part)), at + np.arange(len(part))] = False
                    links[part] += linked @ n[own[right]]
                    if low != high:
                        links[right] += n[own[part]] @ linked
                    a, b = np.nonzero(linked)
                    label = stars(len(own), np.concatenate([np.arange(len(own)), part[a]]), np.concatenate([label, right[b]]))
                some = np.flatnonzero(links)
                out_a.append(node[own[some]])
                out_b.append(node[own[label[some]]])
                out_n.append(links[some])
        none = [np.zeros(0, np.int64)]
        a, b, links = (np.concatenate(c or none) for c in (out_a, out_b, out_n))
        return pa.table({"a": pa.array(a), "b": pa.array(b), "links": pa.array(links)})

    return dealt.groupBy("bucket", "blocks", "low", "high").applyInArrow(check, "a long, b long, links long")


@dataclass
class Graph:
    """points (node, vec, n, first, its hashes), links (a, b, links) as ``enlarged`` gives them, and what audits found."""

    points: DataFrame
    links: DataFrame
    recalls: list[float] = field(default_factory=list)


def audited(points: DataFrame, loose: DataFrame, least: float, most: int) -> float:
    """The share of the links of some points, found by comparing them with all, that lie within components."""
    labelled = points.join(loose.withColumnRenamed("root", "r"), "node", "left").select("node", "vec", F.coalesce("r", "node").alias("root"))
    asked = labelled.orderBy(F.xxhash64("node"), "node").limit(most).toArrow()
    if not len(asked):
        return 1.0
    told = [(asked.column("root").to_numpy()[at], asked.column("node").to_numpy()[at], x) for at, x in units(asked)]
    shared = points.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = there = 0
        for batch in batches:
            for at, x in units(batch):
                root, node = (batch.column(c).to_numpy()[at] for c in ("root", "node"))
                for r, v, y in shared.value:
                    if y.shape[1] == x.shape[1]:
                        linked = (x @ y.T >= least) & (node[:, None] != v[None, :])
                        there += int(linked.sum())
                        met += int((linked & (root[:, None] == r[None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([there])], ["met", "there"])

    met, there = labelled.mapInArrow(run, "met long, there long").agg(F.sum("met"), F.sum("there")).first()
    return met / there if there else 1.0


def near_graph(
    points: DataFrame, threshold: float = 0.9, k: int = 8, orders: int = 4, rounds: int = 2, most_rounds: int = 8, slack: float = 0.02, audit: int = 512, recall: float = 0.98, block: int = 8192, seed: int = 20
) -> Graph:
    """Links of ``threshold`` between ``points`` (node, vec, n)."""
    n = points.count()
    bits = min(40, max(1, int(np.log2(max(2, n / 64)))))
    edges = None
    for order in range(orders):
        found = windows(points, order, bits, k, threshold - slack, seed)
        edges = found if edges is None else edges.union(found)
    edges = cut(edges)
    close = F.col("s") >= threshold - slack
    links, lists, vectors = edges.where(close), cut(best_of(edges, k)), small(points)
    graph, done = Graph(points, links), 0
    while True:
        for _ in range(rounds):
            new = cut(descend(lists, vectors, k))
            links = links.union(new.where(close))
            old = lists.select(F.col("node").alias("u"), F.explode("list").alias("e")).select("u", "e.v", "e.s")
            lists = cut(best_of(old.union(new), k))
            done += 1
        loose = cut(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        graph.recalls.append(audited(points, loose, threshold, audit))
        if graph.recalls[-1] >= recall or done >= most_rounds:
            break
        k, orders = 2 * k, orders + 1
        again = cut(windows(points, orders - 1, bits, k, threshold - slack, seed))
        links = links.union(again.where(close))
        lists = cut(best_of(lists.select(F.col("node").alias("u"), F.explode("list").alias("e")).select("u", "e.v", "e.s").union(again), k))
    if graph.recalls[-1] < recall:
        warnings.warn(f"recall {graph.recalls[-1]:.3f} after {done} rounds", stacklevel=2)
    ends = loose.select(F.col("root").alias("node"), "root").distinct()
    groups = points.select("node", "vec", "n").join(loose.union(ends), "node")
    graph.links = cut(enlarged(groups, threshold, block))
    return graph


def near_duplicates(table: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = named(table)
    points = distinct_points(rows)
    graph = near_graph(points, **options)
    counts = graph.links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(graph.links.select("a", "b"))
    own = points.select("node", "k1", "k2", "n", "first").join(counts, "node", "left").join(roots, "node", "left")
    own = cut(own.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first", F.coalesce("root", "node").alias("root")))
    least = cut(own.groupBy("root").agg(F.min("first").alias("component_id")))
    known = own.join(least, "root").select("k1", "k2", "n_links", "component_id", F.lit(True).alias("known"))
    said = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return said.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
