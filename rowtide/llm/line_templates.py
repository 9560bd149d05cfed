"""Line dedup by a log-template tree.

Lines are parsed down a tree of fixed depth: first their number of tokens, then
``depth`` leading tokens (a token with a digit counts as variable from the start and
reads ``<*>``).  A leaf gathers lines of one shape; within it every place keeps the
tokens that enough documents share there, and any other token is a variable field.  What
remains is the line's template.  A template found in enough documents, with at least
half its tokens constant, is recurring, and its lines are dropped.

How many are enough depends on the number of tokens alone: documents times tokens have to
reach ``evidence``, with two documents at least and ``least_docs`` at most.  A short line
in a few documents is a coincidence, a long one in two is a copy.  A template that
``least_docs`` documents have is boilerplate and goes from all of them; of one that fewer
have, a repeated passage, the document whose text has the least hash keeps its lines.

Counts stand for the whole corpus.  A first pass counts the documents of each leaf; a sieve of them on the executors keeps lines in place that can't
recur, and what it lets through in vain is dropped by the counts that follow.  Equal
lines are one row with a document count before places are counted, and every count is
combined before its shuffle.  Counts are written before they are joined with the rows
they judge, so that Spark splits the join of a hot template, line, text or of all null
texts over tasks.  Only hashes of lines travel, and each document that loses lines gets
back the list of their places.

Defined results: null and empty texts have no lines with tokens and lose none (null
stays null); lines without tokens are never dropped; a line repeated in one document
counts once; documents of equal texts count as one, so a line is not recurring
just because its document was copied, and they lose the same lines; a very long text
is parsed whole, by itself; an empty table gives an empty one.  Input columns named
like an output column are replaced by it; others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import SIEVE_BITS, bitmap, cut, shape_with, sieve, text_batches

VARIABLE = regex.compile(rb"\S*[0-9]\S*")
WILD = b"<*>"
KEY = "__lt_key"


def tokens(line: bytes) -> list[bytes]:
    """Tokens of a line, those with a digit masked."""
    return VARIABLE.sub(WILD, line).split()


def digest(data: bytes) -> int:
    n = xxhash.xxh64_intdigest(data, 7)
    return n - (1 << 64) if n >> 63 else n


def leaf(t: list[bytes], depth: int) -> int:
    return digest(b"%d " % len(t) + b" ".join(t[:depth]))


def parsed(text: str | None, depth: int) -> Iterator[tuple[int, bytes, list[bytes], int]]:
    """(place, line, tokens, leaf) of every line with tokens."""
    for place, line in enumerate((text or "").encode().split(b"\n")):
        t = tokens(line)
        if t:
            yield place, line, t, leaf(t, depth)


FOUND = f"{KEY} binary, leaf long, line long, places array<int>, toks array<long>"


def recurring(source: DataFrame, least_docs: int, depth: int, evidence: int, bits: int) -> DataFrame:
    """(KEY, __lt_places): what each document loses.  ``source`` has KEY and text."""

    def texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[bytes | None, str | None]]:
        for batch in batches:
            for part in text_batches(batch, "text", most):
                yield dict(zip(part.column(KEY).to_pylist(), part.column("text").to_pylist()))

    def enough(docs: str, width: str = "width") -> Column:
        return F.col(docs) >= F.greatest(F.lit(2), F.least(F.lit(least_docs), F.ceil(F.lit(evidence) / F.col(width))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in texts(batches, 2 << 20):
            out = [(key, *x) for key, text in own.items() for x in {(x, len(t)) for _, _, t, x in parsed(text, depth)}]
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()))], [KEY, "leaf", "width"])

    counts = source.mapInArrow(leaves, f"{KEY} binary, leaf long, width long").distinct().groupBy("leaf").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    common = cut(counts.where(enough("n")).select("leaf"))
    slots = 1 << bits
    shared = source.sparkSession.sparkContext.broadcast(bitmap(common, F.pmod("leaf", F.lit(slots)), bits))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        wanted = lambda x: held[x % slots >> 3] >> (x & 7) & 1
        types = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        for some in texts(batches, 2 << 20):
            out: list[tuple] = []
            for key, t in some.items():
                own: dict[tuple, tuple] = {}
                for place, _, toks, x in parsed(t, depth):
                    if wanted(x):
                        own.setdefault((x, digest(b" ".join(toks))), ([], toks))[0].append(place)
                out += [(key, *k, places, [digest(w) for w in toks]) for k, (places, toks) in own.items()]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [KEY, "leaf", "line", "places", "toks"])

    by = (KEY, "leaf", "line")
    found = cut(source.mapInArrow(lines, FOUND).groupBy(*by).agg(F.first("places").alias("places"), F.first("toks").alias("toks")))

    # Tokens travel as a hash of leaf, place and token, beside the number of their line.
    distinct = found.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("toks").alias("toks"))
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    each = distinct.select("id", "leaf", "n", F.size("toks").alias("width"), F.posexplode("toks").alias("pos", "tok")).where(F.col("tok") != digest(WILD))
    each = each.select("id", "n", "width", F.xxhash64("leaf", "pos", "tok").alias("at"))
    shared_tokens = each.groupBy("at").agg(F.sum("n").alias("docs"), F.max("width").alias("width"))
    frequent = cut(shared_tokens.where(enough("docs")).select("at"))
    constant = each.select("id", "at").join(frequent, "at", "left_semi")
    fixed = constant.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("fixed"))
    lines_of = distinct.select("id", "leaf", "line", "n", F.size("toks").alias("width"))
    shapes = fixed.join(lines_of, "id").where(F.size("fixed") * 2 >= F.col("width"))
    shapes = cut(shapes.select("leaf", "line", "n", "width", F.xxhash64("leaf", "fixed").alias("template")))
    repeated = shapes.groupBy("template").agg(F.sum("n").alias("docs"), F.max("width").alias("width"))
    repeated = cut(repeated.where(enough("docs")).select("template", (F.col("docs") >= least_docs).alias("everywhere")))
    named = cut(shapes.join(repeated, "template").select("leaf", "line", "template", "everywhere"))
    held_by = cut(found.select(KEY, "leaf", "line", "places").join(named, ["leaf", "line"]).select(KEY, "places", "template", "everywhere"))
    first = cut(held_by.where("not everywhere").groupBy("template").agg(F.min(KEY).alias("first")))
    passages = held_by.where("not everywhere").join(first, "template").where(F.col(KEY) != F.col("first")).select(KEY, "places")
    lost = held_by.where("everywhere").select(KEY, "places").union(passages)
    return lost.groupBy(KEY).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("__lt_places"))


def drop_templates(docs: DataFrame, least_docs: int = 8, depth: int = 3, evidence: int = 100, bits: int = SIEVE_BITS) -> DataFrame:
    """``docs`` with ``n_lines`` (those with tokens), ``n_dropped`` and ``clean_text``."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "clean_text")]
    keyed = docs.select(*[f"`{c}`" for c in kept]).withColumn(KEY, F.unhex(F.md5(F.col("text").cast("binary"))))
    lost = cut(recurring(keyed.select(KEY, "text"), least_docs, depth, evidence, bits))
    # Texts that lose nothing stay where they are.
    loses = sieve(lost, KEY)(F.col(KEY))
    none = F.lit(None).cast(lost.schema["__lt_places"].dataType)
    joined = keyed.where(loses).join(lost, KEY, "left").drop(KEY).unionByName(keyed.where(~loses).drop(KEY).withColumn("__lt_places", none))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, "text"):
                n, gone, texts = [], [], []
                for t, places in zip(part.column("text").to_pylist(), part.column("__lt_places").to_pylist()):
                    rows, drop = (t or "").split("\n"), set(places or ())
                    n.append(sum(1 for r in rows if r.strip(" \t\n\x0b\x0c\r")))
                    gone.append(len(drop))
                    texts.append(None if t is None else "\n".join(r for i, r in enumerate(rows) if i not in drop) if drop else t)
                columns = [c for c, name in zip(part.columns, part.schema.names) if name != "__lt_places"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], [*kept, "n_lines", "n_dropped", "clean_text"])

    return joined.mapInArrow(clean, shape_with(joined.drop("__lt_places"), "n_lines long, n_dropped long, clean_text string"))
