"""Quality classifier: supervised subword embeddings averaged over a document.

Words and the character n-grams of ``<word>`` are hashed to ``buckets`` learned
vectors; a document is the mean of all its vectors and a softmax layer reads the
label off it.  Training is numpy stochastic gradient descent on the driver over at
most ``max_train`` labelled documents (those of least hash; a documented bound),
whose features, not texts, travel to it: at most ``buckets`` numbers a document.

Scoring covers every whole text.  As the layer on top is linear, the mean of
vectors times the weights is the mean of one number for each feature, so executors
get ``buckets`` floats (256 kB), and keep what a word adds in a bounded memo.

Defined results: a null or empty text has no features and gets the bias alone;
without labelled rows all scores are 0.5; a null label is no label; of repeated
labels of a document the least counts, of repeated rows of a labelled document the one
whose text has the least hash; rows with a null doc_id are scored but never learnt
from; equal texts get equal scores; a very long text is scored whole; an empty table
gives an empty one.  Input columns named like an output column are replaced by it,
others are carried along.  Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.common import cut, shape_with, text_batches

BUCKETS = 1 << 16
GRAMS = (3, 4)
MEMO = 300_000
#: Bytes from which a word is long: taken in slices, of so many letters, and not kept in the memo.
LONG = 400
SLICE = 4096


def slices(word: bytes, buckets: int = BUCKETS) -> Iterator[list[int]]:
    """``features`` in lists of a bounded size."""
    found = [zlib.crc32(word) % buckets]
    letters = f"<{word.decode('utf-8', 'ignore')}>"
    for low in range(0, len(letters), SLICE):
        for n in GRAMS:
            for i in range(low, min(low + SLICE, len(letters) - n + 1)):
                found.append(zlib.crc32(letters[i : i + n].encode(), n) % buckets)
        yield found
        found = []


def features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    if len(word) > LONG or not word.isascii():
        return [f for part in slices(word, buckets) for f in part]
    letters, digest = b"<%b>" % word, zlib.crc32  # a letter is a byte
    return [digest(word) % buckets, *[digest(letters[i : i + n], n) % buckets for n in GRAMS for i in range(len(letters) - n + 1)]]


def counted(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    seen: dict[bytes, int] = {}
    for w in (text or "").encode().split():
        seen[w] = seen.get(w, 0) + 1
    if not seen:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids = [(f, n) for w, n in seen.items() if len(w) <= LONG for f in features(w, buckets)]
    flat = np.array(ids, dtype=np.int64).reshape(-1, 2)
    total = np.bincount(flat[:, 0], weights=flat[:, 1], minlength=buckets)
    for w, n in seen.items():
        for part in slices(w, buckets) if len(w) > LONG else ():
            np.add.at(total, part, n)
    where = np.flatnonzero(total)
    return where.astype(np.int32), (total[where] / total.sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 16, epochs: int | None = None, rate: float = 0.5, seed: int = 5, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """What each feature adds to the logit of label 1, and the bias."""
    if not rows:
        return np.zeros(buckets, np.float32), 0.0
    # About 24,000 steps; a small sample is gone through more often.
    epochs = epochs or min(100, max(8, 24_000 // len(rows)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    top, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(rows)
    for e in range(epochs):
        for k, i in enumerate(rng.permutation(len(rows))):
            ids, share, label = rows[i]
            lr = rate * (1 - (e * len(rows) + k) / steps)
            hidden = share @ vectors[ids]
            z = hidden @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = top @ p
            top -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            # Steps are scaled by the feature's weight in the mean; 20 makes up for its smallness.
            vectors[ids] -= (lr * 20 * share)[:, None] * back
    return vectors @ (top[:, 1] - top[:, 0]), float(bias[1] - bias[0])


class Memo(dict):
    """word -> (sum of its features' weights, number of features)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[float, int]:
        if len(word) > LONG:
            parts = [(float(self.weights[ids].sum()), len(ids)) for ids in slices(word, len(self.weights))]
            return sum(s for s, _ in parts), sum(n for _, n in parts)
        if len(self) >= MEMO:
            self.clear()
        ids = features(word, len(self.weights))
        self[word] = found = (float(self.weights[ids].sum()), len(ids))
        return found


def score_text(text: str | None, memo: Memo, bias: float) -> float:
    total, n = 0.0, 0
    for s, k in map(memo.__getitem__, (text or "").encode().split()):
        total += s
        n += k
    z = bias + (total / n if n else 0.0)
    return 1 / (1 + np.exp(-z)) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 3000, max_bytes: int = 256 << 20, **options) -> tuple[np.ndarray, float]:
    """Learns from labelled documents that are not held out.

    These are at most ``max_train``, in the order of a hash of their ids, and as many as
    have ``max_bytes`` of features together, which is what the driver holds.
    """
    wanted = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    # Repeats of a document are combined where they are read.
    rows = own.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text"):
                pairs = [counted(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array([i.tobytes() for i, _ in pairs], pa.binary()), pa.array([s.tobytes() for _, s in pairs], pa.binary())],
                    ["doc_id", "label", "ids", "share"],
                )

    made = cut(rows.mapInArrow(featurise, f"doc_id {kind}, label int, ids binary, share binary"))
    upto = F.sum(F.length("ids") + F.length("share")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over max_train rows at most
    few = made.select("doc_id", upto.alias("upto")).where(F.col("upto") <= max_bytes).select("doc_id")
    found = made.join(F.broadcast(few), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    view = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
    parts = zip(found["ids"], found["share"], found["label"].to_pylist())
    sample = [(view(i, np.int32), view(s, np.float32), int(y > 0)) for i, s, y in parts if i.as_buffer().size]
    return train(sample, **options)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (of label 1) and ``predicted``; same-named columns are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*[f"`{c}`" for c in kept])
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        for batch in batches:
            for part in text_batches(batch, "text"):
                s = [float(score_text(t, memo, bias)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [*part.schema.names, "score", "predicted"]
                )

    return rows.mapInArrow(run, shape_with(rows, "score double, predicted int"))
