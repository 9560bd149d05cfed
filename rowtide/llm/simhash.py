"""SimHash near-duplicate groups by anchor-point covering.

A text's words are cut into shingles; each shingle's XXH64 votes on 64 bits.  Equal
fingerprints are one point.  Pairs of points within ``max_bits`` are found with a
covering code: the perfect binary Golay code of length 23 (4096 words, covering
radius 3, so every 23-bit string has exactly one code word within 3: its home).

* ``PRODUCT`` (max_bits up to 2) takes bits 0-22 and 23-45 and pairs of code words
  as anchors.  If x and y differ in t bits, y is within 3 + t of x's home; so y is
  replicated to every anchor that exceeds the radius by at most t bits over both
  parts (about 61 of 2^24), and meets x there.
* ``PARTS`` (larger max_bits) takes three parts (23, 23 and 18 bits).  One of them
  holds at most a third of the differing bits, which bounds its replicas.

At an anchor, points at home are compared with all replicas, by all 64 bits; so
every pair within ``max_bits`` is found, and no other.  An anchor gives out a
spanning star of what it links, not its pairs, so a group of copies costs one edge
each.  Anchors travel in blobs for many points; where a key has very many homes or
replicas, both are split into parts and every two parts meet in a task of their own.
Stars are joined into components by alternating large-star and small-star steps over
DataFrames, each written to the shared folder.

For shingle similarity (``near_copies``) a point is a set of shingles, named by a
hash of it; each shingle votes once, however often a text repeats it.  Points of equal
fingerprints are linked like any other, and carry the number of shingles and 16
four-bit minima: only points of about equal sizes meet, and a pair needs some equal
minima beside the few differing bits.  Components of these loose links hold whatever
can be linked; within each of them the sets of shingles decide (``exact``), all
against all in memory, in blocks where a component is large.  A component of m texts
so costs m^2 comparisons (a nanosecond a shingle) but gives out m edges at most.

Defined results: null, empty and wordless texts have fingerprint 0 and are linked
like any other (by ``near_copies`` with each other alone); fewer words than a shingle
are one shingle; a very long text is hashed whole, in slices; repeated rows each get
their component; null ids are never a component's name (null if it has no other);
``near_duplicates`` returns its own three columns whatever else the input has, and
``near_copies`` the input's columns, which may have any name but those that start
with ``__w_``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import cut, sieve, sieve_bits, text_batches

SEED = 42
PART = 1 << 16
PAIRS = 1 << 20

# --- fingerprints ----------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in arrays of a bounded size."""
    w = (text or "").encode().lower().split()
    if not w:
        return
    joined, k = b" ".join(w), min(words, len(w))
    ends = list(accumulate(map(len, w), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(w) - k + 1, PART):
        high = min(low + PART, len(w) - k + 1)
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[low:high], ends[low + k - 1 : high + k - 1])], np.uint64)


MIX = np.uint64(0x9E3779B97F4A7C15)


def minima(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each of 2^bits ranges of sorted hashes, mixed, and whether there is one."""
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    firsts = np.searchsorted(slot, np.arange(1 << bits))
    full = firsts < np.append(firsts[1:], len(h))
    return h[np.minimum(firsts, len(h) - 1)] * MIX, full


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def fingerprint(text: str | None, words: int = 3, sketch: bool = False) -> tuple[int, int, int, int]:
    """Fingerprint and node (the same); with ``sketch`` both of the set of shingles, and that set's 16 four-bit minima and size."""
    votes, n = np.zeros(64, np.int64), 0
    h = shingle_set(text, words) if sketch else None
    for part in (h[i : i + PART] for i in range(0, len(h), PART)) if sketch else shingle_hashes(text, words):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    fp = int(np.packbits(2 * votes > n).view(np.uint64)[0])
    if not sketch:
        return fp, fp, 0, 0
    node = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    few, full = minima(h, 4) if n else (np.zeros(16, np.uint64), np.zeros(16, bool))
    few = np.where(full, few >> np.uint64(60), np.uint64(0))
    return fp, node, int((few << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(dtype=np.uint64)), len(h)


def fingerprints(docs: DataFrame, words: int = 3, sketch: bool = False) -> DataFrame:
    """doc_id, th (a hash of the text), fp, node (names the point), sketch and size of every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text"):
                found = [fingerprint(t, words, sketch) for t in part.column("text").to_pylist()]
                numbers = np.array(found, np.uint64).reshape(-1, 4)
                columns = [pa.array(numbers[:, i].copy().view(np.int64)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *columns], ["doc_id", "th", "fp", "node", "sketch", "size"])

    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long, node long, sketch long, size long")


# --- anchors ---------------------------------------------------------------------


class Golay:
    """Code words near a 23-bit string, from the patterns of each syndrome."""

    GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1

    def __init__(self, slack: int):
        high = np.arange(1 << 12, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            high = np.where(high >> bit & 1, high ^ (self.GENERATOR << (bit - 11)), high)
        self.high = high
        patterns = np.zeros(1, np.int64)
        last, weight = patterns, [0]
        for w in range(1, 4 + slack):
            top = np.where(last > 0, np.floor(np.log2(np.maximum(last, 1))).astype(np.int64), -1)
            last = np.concatenate([last[top < b] | (1 << b) for b in range(23)])
            patterns = np.concatenate([patterns, last])
            weight += [w] * len(last)
        weight = np.array(weight)
        self.by = []
        for s in range(slack + 1):
            own = patterns[weight <= 3] if s == 0 else patterns[weight == 3 + s]
            syndrome = self.syndrome(own)
            order = np.argsort(syndrome, kind="stable")
            self.by.append((own[order], np.searchsorted(syndrome[order], np.arange(2049))))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return (x & 0x7FF) ^ self.high[x >> 11]

    def near(self, x: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, code word's 12-bit label) of all code words at excess ``s`` over the radius."""
        patterns, first = self.by[s]
        syndrome = self.syndrome(x)
        n = first[syndrome + 1] - first[syndrome]
        row = np.repeat(np.arange(len(x)), n)
        place = np.repeat(first[syndrome], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, (x[row] ^ patterns[place]) >> 11


class Cover:
    """Homes and replicas of points; an anchor is (view, sub-anchor, size class) in one integer."""

    def __init__(self, max_bits: int, sized: bool):
        self.max_bits, self.sized = max_bits, sized
        self.product = max_bits <= 2
        self.slack = max_bits if self.product else max_bits // 3
        self.code = Golay(self.slack)

    def cell(self, anchor: np.ndarray, view: int, size: np.ndarray, step: int = 0) -> np.ndarray:
        cls = np.log(np.maximum(size, 1)) / np.log(1.25) if self.sized else np.zeros(len(anchor))
        return ((anchor | view << 12) * 128 + np.minimum(cls.astype(np.int64), 120) + step).astype(np.int32)

    def parts(self, fp: np.ndarray) -> list[np.ndarray]:
        low = [(fp >> np.uint64(k)).astype(np.int64) & 0x7FFFFF for k in (0, 23)]
        return low if self.product else [*low, (fp >> np.uint64(46)).astype(np.int64)]

    def homes(self, fp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, rows = [self.code.near(p, 0)[1] for p in self.parts(fp)], np.arange(len(fp))
        views = [(0, parts[0] << 12 | parts[1])] if self.product else list(enumerate(parts))
        steps = (0, 1) if self.sized else (0,)
        found = [self.cell(a, v, size, s) for v, a in views for s in steps]
        return np.tile(rows, len(found)), np.concatenate(found)

    def replicas(self, fp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, rows, cells = self.parts(fp), [], []
        if not self.product:
            for v, p in enumerate(parts):
                for s in range(self.slack + 1):
                    row, a = self.code.near(p, s)
                    rows.append(row)
                    cells.append(self.cell(a, v, size[row]))
        else:
            for s in range(self.slack + 1):
                row, a = self.code.near(parts[0], s)
                for t in range(self.slack + 1 - s):
                    again, b = self.code.near(parts[1][row], t)
                    rows.append(row[again])
                    cells.append(self.cell(a[again] << 12 | b, 0, size[row[again]]))
        return np.concatenate(rows), np.concatenate(cells)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and edges (a, b) the least node of each one's component."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


def compare(home: tuple, visit: tuple, max_bits: int, least_equal: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes, (node, least node of its component), that span the links between homes and replicas.

    Both are (cell, fp, sketch, node) arrays; without node, nodes are fingerprints.
    """

    def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = stars(len(points), a, b)
        a = np.flatnonzero(root != np.arange(len(points)))
        return a, root[a]

    order = np.argsort(home[0], kind="stable")
    cell, fp, sketch, *_ = (x[order] for x in home)
    mine, other = home[3][order] if len(home) > 3 else fp, visit[3] if len(visit) > 3 else visit[1]
    low, high = (np.searchsorted(cell, visit[0], side=s) for s in ("left", "right"))
    live = np.flatnonzero(high > low)
    n = (high - low)[live]
    ends, at = np.cumsum(n), 0
    points = np.unique(np.concatenate([mine, other[live]]))
    a = b = np.zeros(0, np.int64)
    full = PAIRS
    while at < len(live):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        first, many, v = low[live[at:to]], n[at:to], live[at:to]
        # A single replica meets its homes in slices, if they are very many.
        for skip in range(0, int(many.max()), PAIRS):
            m = np.clip(many - skip, 0, PAIRS)
            y = np.repeat(v, m)
            x = np.repeat(first + skip, m) + np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m)
            ok = (np.bitwise_count(fp[x] ^ visit[1][y]) <= max_bits) & (mine[x] != other[y])
            x, y = x[ok], y[ok]
            if least_equal and len(x):
                change = sketch[x] ^ visit[2][y]
                ok = sum((((change >> np.uint64(4 * k)) & np.uint64(15)) == 0).astype(np.int8) for k in range(16)) >= least_equal
                x, y = x[ok], y[ok]
            a = np.concatenate([a, np.searchsorted(points, mine[x])])
            b = np.concatenate([b, np.searchsorted(points, other[y])])
            if len(a) > full:
                a, b = spanning(a, b)
                full = max(PAIRS, 2 * len(a))
        at = to
    a, b = spanning(a, b)
    return points[a], points[b]


def links(points: DataFrame, max_bits: int, least_equal: int = 0, sized: bool = False, accept_bits: int = 0, hot_points: int = 500_000, group_rows: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that connect what is within ``max_bits``; ``points`` has fp, sketch, size and distinct nodes.

    Pairs up to ``accept_bits`` apart, if that is more, are taken too where they meet.
    Anchors are hashed to as many groups as give each about ``group_rows`` replicas (some
    20 MB): the fewer groups a point is in, the fewer edges span what it is linked to.
    Where a group has more than ``hot_points`` homes, or eight times as many replicas,
    both are split, and every part of the homes meets every part of the replicas.
    """
    more = ("sketch", "node") if least_equal else ()

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        size, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "fp", *more))
        return size, *(x.view(np.uint64) for x in rest)

    def key_of(cell: np.ndarray) -> np.ndarray:
        return ((cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % keys

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, homes, visits = Cover(max_bits, sized), np.zeros(keys, np.int64), np.zeros(keys, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                size, fp, *_ = arrays(batch.slice(at, 4000))
                homes += np.bincount(key_of(cover.homes(fp, size)[1]), minlength=keys)
                visits += np.bincount(key_of(cover.replicas(fp, size)[1]), minlength=keys)
        k = np.flatnonzero(homes + visits)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(homes[k]), pa.array(visits[k])], ["k", "homes", "visits"])

    points = points.select("size", "fp", *more)
    keys = max(16, -(-points.count() * (61 if max_bits <= 2 else 216) // group_rows))
    counts = points.mapInArrow(census, "k long, homes long, visits long").groupBy("k").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
    split = np.ones((2, keys), np.int64)  # parts of the replicas and of the homes
    for r in counts.where((F.col("homes") > hot_points) | (F.col("visits") > 8 * hot_points)).collect():
        split[:, r.k] = -(-r.visits // (8 * hot_points)) or 1, -(-r.homes // hot_points) or 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(max_bits, sized)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                size, fp, *rest = arrays(batch.slice(at, 4000))
                out = []
                for home, (row, cell) in ((1, cover.homes(fp, size)), (0, cover.replicas(fp, size))):
                    key = key_of(cell)
                    # A part of one's own kind, and all parts of the other's.
                    part = (fp[row] % np.uint64(1_000_003)).astype(np.int64) % split[home][key]
                    n = split[1 - home][key]
                    every = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    row, cell, key, part = (np.repeat(x, n) for x in (row, cell, key, part))
                    chunk = part * split[0][key] + every if home else every * split[0][key] + part
                    order = np.lexsort((chunk, key))
                    row, cell, key, chunk = row[order], cell[order], key[order], chunk[order]
                    edge = np.flatnonzero(np.diff(key, prepend=-1) | np.diff(chunk, prepend=-1))
                    for low, high in zip(edge, np.append(edge[1:], len(key))):
                        r = row[low:high]
                        out.append((int(key[low]), int(chunk[low]), home, cell[low:high].tobytes(), *(x[r].tobytes() for x in (fp, *rest))))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * (2 + len(more)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["k", "chunk", "home", "cell", "fp", *more])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        home, rows = table.column("home").to_pylist(), [table.column(c).to_pylist() for c in ("cell", "fp", *more)]

        def side(want: int) -> tuple[np.ndarray, ...]:
            own = [i for i, h in enumerate(home) if h == want]
            cell, fp, *rest = (np.frombuffer(b"".join(x[i] for i in own), np.uint64 if k else np.int32) for k, x in enumerate(rows))
            return cell, fp, *(rest or [fp])

        a, b = compare(side(1), side(0), max(max_bits, accept_bits), least_equal)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = points.mapInArrow(spread, "k long, chunk long, home int, cell binary, fp binary" + "".join(f", {c} binary" for c in more))
    return sent.groupBy("k", "chunk").applyInArrow(meet, "a long, b long")


# --- components ------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is its component's least node.

    Least neighbours are written before they are joined, so that Spark splits the join of
    a node with very many neighbours.  What a step gives is written too, as the next one
    reads it twice; rounds end when the edges are stars, without one more that shows it.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def large(e: DataFrame) -> DataFrame:
        two = both(e)
        least = cut(two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # Repeats are at most as many as edges were; small() drops them.
        return two.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.union(least.select("u", "m")).distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every a has one b, which is no a: as a > b, b is then the least of its component."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        each = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not each.agg(F.max(F.col("up") + F.col("down") > 1)).first()[0]

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(edges):
        edges = cut(small(cut(large(edges))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (th and w_id name a row of ``docs``) with the text in place of the two."""
    passes = sieve(wanted, "th", sieve_bits(wanted.count()))  # so that few other texts travel
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).where(passes(F.col("th")))
    own = wanted.withColumnRenamed("th", "w_th")
    return texts.join(own, (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).drop("doc_id", "th", "w_th", "w_id")


def alike(x: list[np.ndarray], y: list[np.ndarray] | None, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) where x[i] and the y[j] (without y: later x) share ``least`` of their elements; all are sorted sets."""
    every = x + (y or [])
    flat = np.unique(np.concatenate(every), return_inverse=True)[1].astype(np.int32)
    size = np.array([len(s) for s in every])
    first = np.cumsum(size) - size
    # The others in order of size, so that those of about equal size are one stretch.
    others = np.arange(len(x), len(every)) if y is not None else np.arange(len(x))
    others = others[np.argsort(size[others], kind="stable")]
    sizes = size[others]
    starts = np.cumsum(sizes) - sizes
    beside = np.concatenate([flat[first[j] : first[j] + size[j]] for j in others])
    there = np.zeros(int(flat.max()) + 1, np.uint8)
    for i in range(len(x)):
        low, high = np.searchsorted(sizes, size[i] * least - 1e-6), np.searchsorted(sizes, size[i] / least + 1e-6, side="right")
        if low >= high:
            continue
        own = flat[first[i] : first[i] + size[i]]
        there[own] = 1
        part = there[beside[starts[low] : starts[high - 1] + sizes[high - 1]]]
        same = np.add.reduceat(part, starts[low:high] - starts[low], dtype=np.int64)
        there[own] = 0
        near = others[low:high][same + 1e-9 >= least * (size[i] + sizes[low:high] - same)]
        yield i, near - len(x) if y is not None else near[near > i]


def exact(groups: DataFrame, docs: DataFrame, words: int, least: float, block: int = 500_000) -> DataFrame:
    """Edges that span all links, of a shingle similarity of ``least``, within each group.

    ``groups`` has node, root, size and th and doc_id of a text.  A group of more
    than ``block`` shingles is cut into blocks, and each pair of blocks is one task's
    work; small groups share tasks.  So no task holds more than two blocks of shingles (or
    two texts), and what comes out of it are fewer edges than it has texts.
    """
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("w")).where("n > 1 and w > 0"))
    small = sizes.where(F.col("w") <= block).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    blocks = F.ceil(F.col("w") / block).cast("int")
    members = groups.where("size > 0").join(sizes, "root").select("node", "root", blocks.alias("blocks"), "th", F.col("doc_id").alias("w_id"))
    # Rows alike in id and text are one again before their shingles are made, and combined where they are read.
    texts = texts_of(cut(members), docs).groupBy("node", "root", "blocks").agg(F.any_value("text").alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text"):
                sets = [shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "root", "blocks")), pa.array(sets, pa.binary())], ["node", "root", "blocks", "shingles"])

    sets = texts.mapInArrow(cut_up, "node long, root long, blocks int, shingles binary")
    mine, all_blocks = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    sets = sets.withColumn("mine", mine).withColumn("other", F.explode(all_blocks))
    bucket = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(max(1, -(-small // block))))).otherwise(F.col("root"))
    dealt = sets.select("node", "root", "shingles", "mine", "blocks", bucket.alias("bucket"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def check(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        names = [table.column(c).to_pylist() for c in ("node", "root", "mine")]
        own: dict[int, tuple[dict, dict]] = {}
        for node, root, mine, s in zip(*names, table.column("shingles")):
            own.setdefault(root, ({}, {}))[mine != low][node] = np.frombuffer(s.as_buffer(), np.uint64)
        a: list[int] = []
        b: list[int] = []
        for x, y in own.values():
            nodes = np.array([*x, *y], np.int64)
            if low == high and len(x) > 1 or x and y:
                found = [(np.full(len(js), i), js + (len(x) if y else 0)) for i, js in alike([*x.values()], [*y.values()] if low != high else None, least)]
                root = stars(len(nodes), *(np.concatenate(v) for v in zip(*found))) if found else np.arange(len(nodes))
                away = np.flatnonzero(root != np.arange(len(nodes)))
                a += nodes[away].tolist()
                b += nodes[root[away]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "blocks", "low", "high").applyInArrow(check, "a long, b long")


def grouped(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, root) of every point; those that ``edges`` connect share their root."""
    found = components(edges)
    return points.join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, **options) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the least doc_id that can be reached over links."""
    rows = cut(fingerprints(docs, words).select("doc_id", "fp", "sketch", "size"))
    points = cut(rows.select("fp", "sketch", "size").distinct())
    groups = grouped(points, links(points, max_bits, **options), "fp")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(groups, "fp")
    smallest = cut(least.groupBy("root").agg(F.min("first").alias("component_id")))
    names = least.join(smallest, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, words: int = 5, max_bits: int = 11, least_equal: int = 7, accept_bits: int = 20, least: float = 0.8, **options) -> DataFrame:
    """One row of each group of near copies: the one with the least doc_id (nulls last).

    Texts are linked if their shingle similarity is ``least`` or more, by their shingles.
    What comes to that check: texts of 0.8 differ in about 10 of 64 bits; all pairs within
    ``max_bits`` meet, and most of those up to ``accept_bits`` (see the README for how many).
    Of those that meet, ``least_equal`` of 16 minima (lost at 0.8: 1 in 7,000) only leave
    out the far ones.
    """
    rows = cut(fingerprints(docs, words, sketch=True))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "fp", "sketch", "size"))
    points = cut(rows.groupBy("node").agg(first.alias("s")).select("node", "s.*"))
    loose = grouped(points, links(points, max_bits, least_equal, sized=True, accept_bits=accept_bits, **options), "node")
    edges = exact(cut(points.join(loose, "node")), docs, words, least)
    firsts = points.join(grouped(points, edges, "node"), "node")
    winners = firsts.groupBy("root").agg(F.min(F.struct("n", "doc_id", "th")).alias("w"))
    winners = cut(winners.select(F.col("w.doc_id").alias("__w_id"), F.col("w.th").alias("__w_th")))
    named = lambda th, doc_id: th.eqNullSafe(F.col("__w_th")) & doc_id.eqNullSafe(F.col("__w_id"))
    # Rows that are surely none of those to go stay where they are; the others meet the winners.
    going = cut(rows.join(winners, named(rows["th"], rows["doc_id"]), "left_anti").select(F.xxhash64("th", "doc_id").alias("key")))
    n_going = going.count()
    keyed = docs.withColumn("__w_text", F.xxhash64("text"))
    goes = sieve(going, "key", sieve_bits(n_going))(F.xxhash64("__w_text", "doc_id"))
    kept = keyed.where(~goes).unionByName(keyed.where(goes).join(winners, named(F.col("__w_text"), F.col("doc_id")), "left_semi"))
    if rows.count() - n_going == winners.count():
        return kept.drop("__w_text")
    # Rows alike in id and text can't be told apart by the winner's name: the one whose columns hash least stays.
    values = [F.col(f"`{c}`") for c in docs.columns]
    one = F.min_by(F.struct(*values), F.struct(F.xxhash64(*values), F.xxhash64(*[v.isNull() for v in values], *values)))
    return kept.groupBy("doc_id", "__w_text").agg(one.alias("__row")).select("__row.*")
