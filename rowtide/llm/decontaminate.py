"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: a segment holds some whole documents and, for every
term in them, the sorted list of its positions.  ``build_index`` gives segments as rows
that know nothing of any test set, to be stored or searched at once; no shuffle is
needed.  A search takes every window of the test items, starts from the postings of its
rarest term in the segment, and intersects the offset-adjusted lists of the other
terms, rarest first.  What is left after all terms is an exact phrase match.  With
``slack`` a second pass finds proximity matches: places where at least ``least`` of the
window's terms lie within ``slack`` words of where the window has them.  It starts from
the postings of the rarest terms, as many as can't all be missing, and leaves a place
as soon as too many terms are missing there.

The test set is read in blocks of at most ``block_words`` words (and one item).  The
driver holds one block at a time, and executors get one at a time: where there are
several, each one's findings are written to the shared folder before the next is built.
So a block's size bounds the broadcast, whatever the size of the whole set.

Defined results: null and empty texts have no words and no hits; an item without
words has no window; an item of fewer than ``n`` words is one window; repeated
items and documents each get their own results; items with a null id are searched,
hit words, but are not named; very long texts are a segment each; empty tables give no
hits.  ``decontaminate`` returns its own columns whatever else the input has; ``flag``
keeps the input's, and replaces one named ``contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import cut, shape_with, text_batches

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SEGMENT_BYTES = 2 << 20
CANDIDATES = 1 << 19
SLACK, LEAST = 2, 0.8
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Block:
    """Some test items: their terms, their distinct windows, and who owns each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.terms = {t: i for i, t in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.n, self.items = n, [i for i, _ in items]
        found: dict[tuple[int, ...], list[int]] = {}
        for k, (_, ws) in enumerate(items):
            ids = [self.terms[w] for w in ws]
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[i : i + n]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.groups = []
        for length in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == length]
            owners = [found[w] for w in own]
            starts = np.cumsum([0, *map(len, owners)])
            self.groups.append((np.array(own, np.int32), starts, np.array([k for o in owners for k in o], np.int64)))


def blocks_of(benchmark: DataFrame, n: int, block_words: int) -> Iterator[Block]:
    """The test set in blocks, each built as its rows pass through the driver; one without items if there are none."""
    items, total, some = [], 0, False
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(ITEM_WORD), 0)  # cut by Spark's tasks
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).toLocalIterator():
        ws = [w.encode() for w in r.words]
        if ws and items and total + len(ws) > block_words:
            yield Block(items, n)
            items, total, some = [], 0, True
        if ws:
            items.append((r.item_id, ws))
            total += len(ws)
    if items or not some:
        yield Block(items, n)


def postings(word_lists: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words of each document, the terms, how often each one stands there, and where, in running numbers."""
    lengths = np.array([len(w) for w in word_lists], np.int32)
    ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(word_lists)))}
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(word_lists)), np.int32, int(lengths.sum()))
    return lengths, [*ids], np.bincount(flat, minlength=len(ids)).astype(np.int32), np.argsort(flat, kind="stable").astype(np.int32)


class Segment:
    """Postings of some documents, those terms numbered that a block has.

    Documents follow each other at such a distance that no match reaches from one into the next.
    """

    def __init__(self, lengths: np.ndarray, terms: list[bytes], counts: np.ndarray, places: np.ndarray, block: Block, slack: int = 0):
        gap = block.n + 4 * slack
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths + gap) - self.lengths
        self.places = places + np.repeat(np.arange(1, len(lengths) + 1) * gap, self.lengths)[places]
        names = np.array([block.terms.get(t, -1) for t in terms], np.int64)
        known = names >= 0
        self.df, self.first = np.zeros((2, len(block.terms)), np.int64)
        self.df[names[known]] = counts[known]
        self.first[names[known]] = (np.cumsum(counts, dtype=np.int64) - counts)[known]
        self.at = np.full(int(self.lengths.sum()) + (len(lengths) + 1) * gap + 1, -1, np.int32)
        self.at[self.places[np.repeat(known, counts)]] = np.repeat(names[known], counts[known])

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every exact occurrence."""
        df = self.df[windows]
        live = np.flatnonzero(df.min(axis=1) > 0)
        order = np.argsort(df[live], axis=1, kind="stable")
        for k, place in self.occurrences(windows[live], order[:, :1]):
            w, start = live[k], place - order[k, 0]
            for j in range(1, windows.shape[1]):
                o = order[k, j]
                ok = self.at[start + o] == windows[w, o]
                k, w, start = k[ok], w[ok], start[ok]
                if not len(k):
                    break
            if len(k):
                yield w, start

    def occurrences(self, windows: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place) for every posting of the terms ``windows[row, which[row]]``, a bounded number at once."""
        for j in range(which.shape[1]):
            terms = windows[np.arange(len(windows)), which[:, j]]
            many = self.df[terms]
            ends = np.cumsum(many)
            for low in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
                x = np.arange(low, min(low + CANDIDATES, int(ends[-1])))
                k = np.searchsorted(ends, x, side="right")
                yield k, self.places[self.first[terms[k]] + x - (ends[k] - many[k])]

    def near(self, windows: np.ndarray, slack: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) where at least ``least`` of the terms lie within ``slack`` of their places."""
        n = windows.shape[1]
        need = int(np.ceil(least * n - 1e-9))
        df = self.df[windows]
        live = np.flatnonzero((df > 0).sum(axis=1) >= need)
        rank = np.argsort(np.where(df > 0, df, np.iinfo(np.int64).max), axis=1, kind="stable")[live]
        there = np.append(self.at, -1)
        # One of the terms that must be present is among the first n - need + 1 by rarity.
        for j in range(n - need + 1):
            some = df[live, rank[:, j]] > 0
            for k, place in self.occurrences(windows[live[some]], rank[some, j : j + 1]):
                k = np.flatnonzero(some)[k]
                place = place - rank[k, j]
                for wide, shifts in ((2 * slack, (0,)), (slack, range(-slack, slack + 1))):
                    # First whatever may match a start within ``slack`` of this one, then each of these starts.
                    k, start = np.tile(k, len(shifts)), np.concatenate([place + d for d in shifts])
                    missing = np.zeros(len(k), np.int8)
                    for o in range(n):
                        x = rank[k, o]
                        want, at = windows[live[k], x], start + x
                        found = np.zeros(len(k), bool)
                        for d in range(-wide, wide + 1):
                            found |= there[np.clip(at + d, -1, len(there) - 1)] == want
                        missing += ~found
                        ok = missing <= n - need
                        k, start, missing = k[ok], start[ok], missing[ok]
                    place = start
                if len(k):
                    yield live[k], place

    def search(self, block: Block, slack: int = 0, least: float = LEAST) -> tuple[np.ndarray, list[set[int]], list[set[int]]]:
        """Hit positions, and for each document the items with exact and with near matches."""
        change = np.zeros(len(self.at) + 1, np.int64)
        exact = [set() for _ in self.lengths]
        close = [set() for _ in self.lengths]
        # A near match may begin before its document's first word.
        edges = self.starts - block.n - slack
        for windows, firsts, owners in block.groups:
            for found, into in ((self.phrases(windows), exact), (self.near(windows, slack, least) if slack else (), close)):
                for w, start in found:
                    if into is exact:
                        np.add.at(change, start, 1)
                        np.add.at(change, start + windows.shape[1], -1)
                    doc = np.searchsorted(edges, start, side="right") - 1
                    for d, k in np.unique(np.stack([doc, w], axis=1), axis=0):
                        into[d].update(owners[firsts[k] : firsts[k + 1]].tolist())
        hit = np.cumsum(change[:-1]) > 0
        own = np.repeat(self.starts - (np.cumsum(self.lengths) - self.lengths), self.lengths) + np.arange(int(self.lengths.sum()))
        return hit[own], exact, close


INDEX = "doc_ids array<{id}>, lengths binary, terms binary, counts binary, places binary"
FOUND = INDEX.split(", terms")[0] + ", hits binary, items array<array<string>>, near array<array<string>>"
RESULT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


def names_of(shape: str) -> list[str]:
    return [x.split()[0] for x in shape.split(", ")]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """(rows of the batch, their postings) for pieces of the input of a bounded size."""
    for batch in batches:
        for part in text_batches(batch, "text", SEGMENT_BYTES):
            yield part, postings([word_list(t) for t in part.column("text").to_pylist()])


def build_index(docs: DataFrame) -> DataFrame:
    """The index as rows, one for each segment, whole in itself; it serves any test set."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (lengths, terms, counts, places) in segments(batches):
            ids = rows.column("doc_id")
            packed = [pa.array([x], pa.binary()) for x in (lengths.tobytes(), b" ".join(terms), counts.tobytes(), places.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *packed], names_of(INDEX))

    return docs.select("doc_id", "text").mapInArrow(run, INDEX.format(id=kind))


def looked_up(row: pa.RecordBatch, block: Block, slack: int, least: float) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[set[str]]]:
    """Words of each of one index row's documents, which of them are hit, and the names of items found."""
    raw = [row.column(c)[0].as_buffer() for c in names_of(INDEX)[1:]]
    lengths, counts, places = (np.frombuffer(raw[i], np.int32) for i in (0, 2, 3))
    hit, *found = Segment(lengths, raw[1].to_pybytes().split(), counts, places, block, slack).search(block, slack, least)
    return lengths, hit, *([{block.items[k] for k in s if block.items[k] is not None} for s in sets] for sets in found)


def hits_of(lengths: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Hit words of each document."""
    upto, ends = np.concatenate([[0], np.cumsum(hit)]), np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


def summary(lengths: np.ndarray, hit: np.ndarray, names: list[set[str]], near: list[set[str]]) -> list[pa.Array]:
    """The columns of RESULT after the first."""
    hits = hits_of(lengths, hit)
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
    count = lambda sets: pa.array([len(x) for x in sets], pa.int64())
    return [pa.array(lengths, pa.int64()), pa.array(hits, pa.int64()), count(names), pa.array(digest, pa.string()), pa.array(hits > 0, pa.bool_()), count(near)]


def search(index: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = 5_000_000, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """One row for each indexed document, with what of ``benchmark`` is found in it; see RESULT."""
    kind = dict(index.dtypes)["doc_ids"][len("array<") : -1]
    context = index.sparkSession.sparkContext

    def each(shared: Broadcast, give):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    yield give(row, looked_up(row, shared.value, slack, least))

        return run

    def result(row: pa.RecordBatch, found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), *summary(*found)], names_of(RESULT))

    def partly(row: pa.RecordBatch, found: tuple) -> pa.RecordBatch:
        _, hit, names, near = found
        lists = pa.list_(pa.list_(pa.string()))
        more = [pa.array([np.packbits(hit).tobytes()], pa.binary()), *(pa.array([[sorted(x) for x in sets]], lists) for sets in (names, near))]
        return pa.RecordBatch.from_arrays([row.column("segment"), row.column("doc_ids"), row.column("lengths"), *more], ["segment", *names_of(FOUND)])

    def merged(table: pa.Table) -> pa.Table:
        rows = [b.slice(i, 1) for b in table.combine_chunks().to_batches() for i in range(b.num_rows)]
        lengths = np.frombuffer(rows[0].column("lengths")[0].as_buffer(), np.int32)
        hits = [np.unpackbits(np.frombuffer(r.column("hits")[0].as_buffer(), np.uint8), count=int(lengths.sum())).view(bool) for r in rows]
        sets = [[set().union(*(x or () for x in own)) for own in zip(*(r.column(c)[0].as_py() for r in rows))] for c in ("items", "near")]
        return pa.Table.from_batches([result(rows[0], (lengths, reduce(np.logical_or, hits), *sets))])

    blocks = blocks_of(benchmark, n, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return index.mapInArrow(each(context.broadcast(first), result), RESULT.format(id=kind))
    index = cut(index.withColumn("segment", F.monotonically_increasing_id()))
    found = []
    for block in chain([first, second], blocks):
        shared = context.broadcast(block)
        found.append(cut(index.mapInArrow(each(shared, partly), f"segment long, {FOUND.format(id=kind)}")))
        shared.unpersist()
    return reduce(DataFrame.union, found).groupBy("segment").applyInArrow(merged, RESULT.format(id=kind))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document its words, hit words, and items found exactly and nearly; see RESULT."""
    return search(build_index(docs), benchmark, **options)


def flag(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = 5_000_000) -> DataFrame:
    """Every row of ``docs``, with ``contaminated`` (by exact matches); index and search stay in one task."""
    kept = [c for c in docs.columns if c.lower() != "contaminated"]
    rows = docs.select(*[f"`{c}`" for c in kept]).withColumn("contaminated", F.lit(False))

    def by(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part, (lengths, terms, counts, places) in segments(batches):
                hit, *_ = Segment(lengths, terms, counts, places, block).search(block)
                now = (hits_of(lengths, hit) > 0) | part.column("contaminated").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(now, pa.bool_())], part.schema.names)

        return run

    context, shape = docs.sparkSession.sparkContext, shape_with(rows.drop("contaminated"), "contaminated boolean")
    blocks = blocks_of(benchmark, n, block_words)
    block = next(blocks)
    while block is not None:
        shared, block = context.broadcast(block), next(blocks, None)
        rows = rows.mapInArrow(by(shared), shape)
        if block is not None:
            rows = cut(rows)
            shared.unpersist()
    return rows
