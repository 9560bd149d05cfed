"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets.  Sources share ``total`` words by weight; no target passes ``cap``
   times its source's words, and what is cut off is shared anew by weight until
   none is above.
2. Quotas.  A target of r times a source takes every document floor(r) times and
   once more those whose hash lies under a threshold.  Thresholds are set for four
   size classes from long to short texts, each making up for what the longer ones
   missed, so a source misses its target by half a short text at most (if it has
   short ones).  A threshold is found bits by bits, from sums over at most 256 hash
   ranges a source, so a hot source is no more work for a task than any other.  A
   source's hash range is cut into blocks of about ``block_rows`` documents; blocks
   times passes are the exact quota of the source.
3. Splitting tree.  The output shards are halved again and again; at each node the
   number of each source's blocks that goes left is drawn from the multivariate
   hypergeometric distribution, so rows and columns of the table (source, shard)
   add up exactly.  With more than ``bucket_sources`` sources the driver draws for
   buckets of sources, and a task draws for the sources of a bucket, given its share.
4. Blocks.  Within a source and pass the blocks are permuted; shard j draws the
   positions that follow those of shard j-1.  So shards are disjoint and every
   place is a function of the document's hash.
5. Rows are shuffled within their shard by a hash of document and pass.

Rows alike in every column are one group with a count from the start, and a threshold
may take any number of them; they are made again as rows when places are known.

Driver memory: one row of numbers for each bucket of sources and shard.  The documents
are read once into a slim table (no texts) in the shared folder, and once more for the
result.  The plan, one row a source, is broadcast up to BROADCAST_SOURCES sources and
joined beyond.  The drawing takes up to BLOCKS_MOST blocks, so 10^8 sources.

Defined results: a null source is a source of its own and sorts last; a null text
has size 0; a source whose texts are all empty has target 0 and is not taken; a very
long text counts by its words, like any other; an empty table gives an empty one.
Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.common import WORD, cut, sieve

#: Least sizes, in words, of the size classes after the first.
CLASSES = (4096, 512, 64)
H, COPY, ROW = "__mix_h", "__mix_c", "__mix_row"
ALL = (1 << 63) - 1
LEVEL_BITS = 8
BLOCKS_MOST = 1 << 29
BROADCAST_SOURCES = 20_000
HOT_ROWS = 50_000

# --- targets and quotas ------------------------------------------------------------


def by_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Inner join by source, null being a source; ``sources`` has one row for each."""
    own = sources.withColumnRenamed("source", "__mix_source")
    return rows.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``idx``, their place by code points, null last."""
    by = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(64, by).withColumn("pid", F.spark_partition_id()))
    counts = dict(parts.groupBy("pid").count().collect())
    before, at = {}, 0
    for pid in sorted(counts):
        before[pid], at = at, at + counts[pid]
    first = F.get(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)]), F.col("pid"))
    return parts.withColumn("idx", F.row_number().over(Window.partitionBy("pid").orderBy(by)) - 1 + first).drop("pid")


def level(sources: DataFrame, total: float, cap: int) -> float:
    """The words for a weight of 1 at which shares, none above ``cap`` times its source, add up to ``total``."""
    full = F.col("source_size") * cap < F.col("weight") * F.lit(0.0)
    now = 0.0
    while True:
        r = sources.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("cut"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r.open:
            return math.inf
        new = (total - (r.cut or 0)) / r.open
        if new <= now * (1 + 1e-12):
            return now
        now = new
        full = F.col("source_size") * cap < F.col("weight") * F.lit(now)


def nearest(rows: DataFrame, due: DataFrame, few: bool) -> DataFrame:
    """(source, edge, take, got): the groups under hash ``edge`` and ``take`` rows of the one at it, ``got`` words in all.

    ``due`` has (source, quota), less than the source has words in ``rows``.
    """
    have, shift = due.select("source", "quota", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), 63
    within = lambda: by_source(rows, have, few).where(F.shiftright(H, shift) == F.col("prefix"))
    words = F.col("size") * F.col("n")
    hit = (F.col("upto") - F.col("w") < F.col("quota")) & (F.col("quota") <= F.col("upto"))
    while shift:
        low = max(0, shift - LEVEL_BITS)
        bins = within().groupBy("source", F.shiftright(H, low).alias("b")).agg(F.sum(words).alias("w"), F.count("*").alias("c"), F.max("quota").alias("quota"), F.max("before").alias("before"))
        upto = F.col("before") + F.sum("w").over(Window.partitionBy("source").orderBy("b"))
        have = cut(bins.withColumn("upto", upto).where(hit).select("source", "quota", F.col("b").alias("prefix"), (F.col("upto") - F.col("w")).alias("before"), "c"))
        most = have.agg(F.max("c")).first()[0] or 0
        have, shift = have.drop("c"), low
        if most <= 1 << LEVEL_BITS:
            break
    order = Window.partitionBy("source").orderBy(H, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    near = within().withColumn("w", words).withColumn("upto", F.col("before") + F.sum("w").over(order)).where(hit)
    take = F.round((F.col("quota") - (F.col("upto") - F.col("w"))) / F.col("size")).cast("long")
    return near.select("source", F.col(H).alias("edge"), take.alias("take"), (F.col("upto") - F.col("w") + take * F.col("size")).alias("got"))


def thresholds(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``sources`` with edges and takes, one for each size class: what the part pass takes of a source."""
    none = F.array().cast("array<long>")
    state = sources.withColumns({"edges": none, "takes": none, "taken": F.lit(0).cast("long"), "seen": F.lit(0).cast("long")})
    for c in range(len(CLASSES) + 1):
        w = F.get("w", F.lit(c))
        state = state.withColumn("seen", F.col("seen") + w)
        due = F.when((F.col("part") > 0) & (w > 0), F.col("part") * F.col("seen") / F.col("source_size") - F.col("taken")).otherwise(0.0)
        state = cut(state.withColumn("due", due))
        whole, some = (w > 0) & (F.col("due") >= w), (w > 0) & (F.col("due") > 0) & (F.col("due") < w)
        wanted = state.where(some).select("source", F.col("due").alias("quota"))
        if wanted.isEmpty():
            edge = take = got = F.lit(None).cast("long")
        else:
            found = nearest(rows.where(F.col("cls") == c), wanted, few).withColumnRenamed("source", "__mix_source")
            state = state.join(F.broadcast(found) if few else found, F.col("source").eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source")
            edge, take, got = F.col("edge"), F.col("take"), F.col("got")
        state = state.withColumns(
            {
                "edges": F.array_append("edges", F.when(whole, F.lit(ALL)).otherwise(F.coalesce(edge, F.lit(-1).cast("long")))),
                "takes": F.array_append("takes", F.when(whole, F.lit(ALL)).otherwise(F.coalesce(take, F.lit(0).cast("long")))),
                "taken": F.col("taken") + F.when(whole, w).otherwise(F.coalesce(got, F.lit(0).cast("long"))),
            }
        ).select(*sources.columns, "edges", "takes", "taken", "seen")
    return cut(state.drop("taken", "seen"))


# --- splitting tree ----------------------------------------------------------------


def even_columns(total: int, shards: int) -> list[int]:
    """``total`` dealt out by halving the shards again and again."""
    if shards == 1:
        return [total]
    left = total * (shards // 2) // shards
    return even_columns(left, shards // 2) + even_columns(total - left, shards - shards // 2)


def split_quotas(quotas: list[int], columns: list[int], seed: list[int]) -> np.ndarray:
    """Table (source, shard) of block counts whose rows add up to ``quotas`` and columns to ``columns``."""
    table = np.zeros((len(quotas), len(columns)), dtype=np.int64)
    todo = [(0, len(columns), np.asarray(quotas, dtype=np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            table[:, low] = have
            continue
        middle = (low + high) // 2
        draw = sum(columns[low:middle])
        rng = np.random.default_rng([*seed, low, high])
        left = rng.multivariate_hypergeometric(have, draw, method="marginals") if draw else np.zeros_like(have)
        todo += [(low, middle, left), (middle, high, have - left)]
    return table


PLAN = (
    "source string, source_size long, target double, full int, edges array<long>, takes array<long>, shift int,"
    "passes array<struct<e:int,start:long,size:long,a:long,b:long>>, bounds array<long>"
)


def planned(sources: DataFrame, shards: int, seed: int, bucket_sources: int) -> DataFrame:
    """One row a source; see PLAN.  ``sources`` has idx, bits and the like."""
    top = F.array_max("edges")
    part = F.when(top >= 0, F.expr("shiftright(array_max(edges), shift)") + 1).otherwise(F.lit(0).cast("long"))
    whole = F.expr("shiftleft(1L, 63 - shift)")
    sources = cut(sources.withColumns({"whole": whole, "rest": part, "bucket": F.floor(F.col("idx") / bucket_sources)}))
    shares = dict(sources.groupBy("bucket").agg(F.sum(F.col("whole") * F.col("full") + F.col("rest"))).collect())
    order = sorted(shares)
    columns = dict(zip(order, split_quotas([shares[b] for b in order], even_columns(sum(shares.values()), shards), [seed]).tolist()))

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        passes = [[int(w)] * int(f) + [int(r)] * (r > 0) for w, f, r in zip(rows["whole"], rows["full"], rows["rest"])]
        bounds = split_quotas([sum(p) for p in passes], columns[key[0]], [seed, 1, int(key[0])]).cumsum(axis=1)
        spread = []
        for i, own in zip(rows["idx"], passes):
            rng, start, out = np.random.default_rng([seed, 2, int(i)]), 0, []
            for e, size in enumerate(own):
                a = next(int(x) for x in rng.integers(1, size + 1, 1000) if math.gcd(int(x), size) == 1)
                out.append({"e": e, "start": start, "size": size, "a": a, "b": int(rng.integers(0, size))})
                start += size
            spread.append(out)
        return rows.assign(passes=spread, bounds=bounds.tolist())[[x.split()[0] for x in PLAN.split(",") if " " in x]]

    return sources.groupBy("bucket").applyInPandas(draw, PLAN)


# --- documents ---------------------------------------------------------------------


def slim(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size, size class and a 63-bit hash of every row; nothing of the texts."""
    values = [F.col(f"`{c}`") for c in docs.columns]
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[v.isNull() for v in values], *values), 1)
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), h.alias(H), *more)
    cls = F.lit(len(CLASSES))
    for k, least in reversed(list(enumerate(CLASSES))):
        cls = F.when(F.col("size") > least, F.lit(k)).otherwise(cls)
    return rows.withColumn("cls", cls)


def each_copy(groups: DataFrame, hot: bool) -> DataFrame:
    """A row for each of the ``n`` rows of a group, numbered in COPY; those of a hot one come from many tasks."""
    if hot:
        pieces = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / HOT_ROWS)))).repartition(H, "k")
    else:
        pieces = groups.withColumn("k", F.lit(0))
    last = F.least(F.col("n"), (F.col("k") + 1) * HOT_ROWS) - 1
    return pieces.withColumn(COPY, F.explode(F.sequence((F.col("k") * HOT_ROWS).cast("long"), last.cast("long")))).drop("k", "n")


def plan_mix(
    docs: DataFrame,
    weight: Column | None = None,
    total_share: float = 1.0,
    cap: int = 3,
    shards: int = 16,
    block_rows: int = 64,
    seed: int = 11,
    bucket_sources: int = 5_000,
) -> tuple[DataFrame, DataFrame]:
    """The slim table of all groups of equal documents (``n`` of them), and per source its words, target and block plan.

    ``weight`` is an expression over ``source`` and ``idx``, the source's place in order;
    by default sources weigh 1, 2, 3, 1, 2, 3 and so on.
    """
    table = cut(slim(docs, seed).groupBy("doc_id", "source", "size", "cls", H).agg(F.count("*").alias("n")))
    words = [F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("size") * F.col("n"))), F.lit(0).cast("long")) for c in range(len(CLASSES) + 1)]
    per = table.groupBy("source").agg(F.array(*words).alias("w"), F.sum("n").alias("rows"))
    sources = numbered(per).withColumn("source_size", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x))
    sources = cut(sources.withColumn("weight", (F.lit(1) + F.col("idx") % 3 if weight is None else weight).cast("double")))
    n_sources, n_words, n_rows = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    few = n_sources <= BROADCAST_SOURCES
    size, share = F.col("source_size"), F.col("weight") * F.lit(level(sources, int(total_share * n_words), cap))
    target = F.when((size == 0) | (share > size * cap), (size * cap).cast("double")).otherwise(share)
    sources = sources.withColumn("target", target).withColumn("full", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    sources = thresholds(table, sources.withColumn("part", F.col("target") - F.col("full") * size), few)

    per_block = max(block_rows, -(-n_rows * (cap + 1) // (BLOCKS_MOST // 2)))
    least_bits = min(math.ceil(math.log2(8 * shards)), max(0, int(math.log2(BLOCKS_MOST / 2 / (max(1, n_sources) * (cap + 1))))))
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / per_block))), F.lit(least_bits))
    return table, cut(planned(sources.withColumn("shift", (63 - bits).cast("int")), shards, seed, bucket_sources))


def place(rows: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """Slim rows, numbered in COPY within their group, with ``copies`` and ``places``, an array of (pass, shard, rank)."""
    joined = by_source(rows, plan, plan.count() <= BROADCAST_SOURCES)
    edge, take = F.get("edges", F.col("cls")), F.get("takes", F.col("cls"))
    taken = (F.col(H) < edge) | ((F.col(H) == edge) & (F.col(COPY) < take))
    own = F.when(F.col(COPY) == 0, F.col(H)).otherwise(F.shiftrightunsigned(F.xxhash64(H, COPY), 1))

    def one(p):
        # The shift differs by source.
        position = p["start"] + F.pmod(F.expr("shiftright(__mix_own, shift)") * p["a"] + p["b"], p["size"])
        shard = F.size(F.filter("bounds", lambda x: x <= position))
        return F.struct(p["e"].alias("copy"), shard.alias("shard"), F.xxhash64(F.lit(seed), "__mix_own", p["e"]).alias("rank"))

    joined = joined.withColumns({"copies": F.col("full") + taken.cast("int"), "__mix_own": own})
    return joined.withColumn("places", F.transform(F.filter("passes", lambda p: p["e"] < F.col("copies")), one)).drop("__mix_own")


def placed(table: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """``place`` for every row that the slim ``table`` stands for."""
    return place(each_copy(table, (table.agg(F.max("n")).first()[0] or 0) > HOT_ROWS), plan, seed)


def mix(docs: DataFrame, shards: int = 16, seed: int = 11, part_rows: int = 2000, in_order: bool = True, **options) -> DataFrame:
    """The mixed rows: every column of ``docs`` plus ``mix_shard`` and ``mix_copy``, each shard shuffled.

    Without ``in_order`` the rows stay where they are, for one who shuffles them next.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("mix_shard", "mix_copy")])
    table, plan = plan_mix(docs, shards=shards, seed=seed, **options)
    n, most = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = slim(docs, seed, F.struct(*[f"`{c}`" for c in docs.columns]).alias(ROW))
    single = rows
    if most > 1:
        repeated = table.where("n > 1").select(H, "n")
        maybe = sieve(repeated, H)(F.col(H))  # so that few other rows travel
        some = rows.where(maybe)
        one = some.join(repeated, H).groupBy(H).agg(*[F.first(c).alias(c) for c in ("source", "size", "cls", "n", ROW)])
        rest = each_copy(one, most > HOT_ROWS)
        single = rows.where(~maybe).unionByName(some.join(repeated, H, "left_anti"))
    rows = single.select("source", "size", "cls", H, ROW, F.lit(0).cast("long").alias(COPY))
    if most > 1:
        rows = rows.unionByName(rest)
    taken = place(rows, plan, seed).select(ROW, F.explode("places").alias("p"))
    each = taken.select(f"{ROW}.*", F.col("p.shard").alias("mix_shard"), F.col("p.copy").alias("mix_copy"), F.col("p.rank").alias("__mix_rank"))
    if not in_order:
        return each.drop("__mix_rank")
    # A shard is dealt out in ``parts`` stretches of its order, so it may be larger than a task.
    parts = max(1, -(-n // (shards * part_rows)))
    stretch = F.floor(F.shiftrightunsigned("__mix_rank", 1) / F.lit(2.0**63 / parts))
    dealt = each.withColumn("__mix_part", stretch).repartition("mix_shard", "__mix_part")
    return dealt.sortWithinPartitions("mix_shard", "__mix_part", "__mix_rank").drop("__mix_part", "__mix_rank")
