"""Shuffled sharding by a Feistel permutation over global row numbers.

Rows get gapless global numbers in an order that depends on their content alone
(not on files or partitions).  A keyed Feistel network on Z_a x Z_b, a*b >= n,
with cycle walking permutes [0, n); the image p of a row gives its shard
``p % shards`` and slot ``p div shards``.  Both can be computed for any number
without touching data, shard counts differ by one at most and slots are gapless.

Numbering takes one grouped count (two hashes and a count a row are shuffled,
combined before) and one window over small hash buckets; the buckets' own first numbers
come from sums over thousands of them and a window within these.  Rows alike in every
column are interchangeable, so a group of more than ``hot_rows`` of them is kept
as one row and its count, and made again in pieces after its numbers are known;
no bucket grows with a hot key.

Defined results: nulls are ordinary values; equal rows take different slots; an
empty table gives an empty one.  Input columns named like an output column are
replaced by it, others are carried along.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.common import cut, let

ROUNDS = 6
#: Buckets whose sizes are summed up in one step.
RANGE = 2048
WALKS = 40
H1, H2, BUCKET, NUMBER = "__sh_h1", "__sh_h2", "__sh_bucket", "__sh_number"


def permuted(x: Column, n: int, seed: int) -> Column:
    """The image of ``x`` in [0, n) under the permutation named by ``seed``.

    Fewer than sqrt(n) of the a*b points lie outside [0, n), so a walk leaves them
    at once but for a share of 1/sqrt(n); a walk of more than WALKS steps, which no
    size makes likely, raises an error instead of giving a wrong place.
    """
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            modulus = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
            mixed = F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), modulus)
            return F.struct(s["r"].alias("l"), F.pmod(s["l"] + mixed, modulus).alias("r"))

        low = v % F.lit(b)
        start = F.struct(((v - low) / F.lit(b)).cast("long").alias("l"), low.cast("long").alias("r"))
        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    first = once(x)
    walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), y, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
    checked = lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    return let(first, lambda y: F.when(y < n, y).otherwise(let(walk(y), checked)))


def number_rows(docs: DataFrame, hot_rows: int = 50_000, bucket_rows: int = 20_000) -> tuple[DataFrame, int]:
    """``docs`` with gapless numbers from 0 in column NUMBER, and how many rows there are."""
    columns = docs.columns
    values = [F.col(f"`{c}`") for c in columns]
    absent = [v.isNull() for v in values]
    keyed = docs.withColumns({H1: F.xxhash64(*values, *absent), H2: F.xxhash64(*absent, *values)})
    groups = cut(keyed.groupBy(H1, H2).agg(F.count("*").alias("c")))
    n, n_hot = groups.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > hot_rows)).first()
    buckets = max(64, n // bucket_rows)
    groups = groups.withColumn(BUCKET, F.pmod(F.col(H1), F.lit(buckets)))

    # The first number of every bucket and, after these, of every hot group.
    plain = groups.where(F.col("c") <= hot_rows).groupBy(BUCKET).agg(F.sum("c").alias("c"))
    sizes = plain.select(BUCKET, F.floor(F.col(BUCKET) / RANGE).alias("range"), F.lit(0).cast("long").alias(H1), F.lit(0).cast("long").alias(H2), "c", F.lit(False).alias("hot"))
    if n_hot:
        sizes = sizes.unionByName(groups.where(F.col("c") > hot_rows).withColumns({"hot": F.lit(True), "range": F.pmod(F.col(H1), F.lit(-(-n_hot // RANGE)))}))
    before = lambda window: F.coalesce(F.sum("c").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("hot", "range").agg(F.sum("c").alias("c"))
    ranges = ranges.select("hot", "range", before(Window.orderBy("hot", "range")).alias("base"))
    inside = before(Window.partitionBy("hot", "range").orderBy(BUCKET, H1, H2))
    sizes = sizes.withColumn("inside", inside).join(ranges, ["hot", "range"]).withColumn("first", F.col("base") + F.col("inside"))

    rows = keyed.withColumn(BUCKET, F.pmod(F.col(H1), F.lit(buckets)))
    hot = sizes.where("hot").select(H1, H2, "first", "c")
    if n_hot:
        rows = rows.join(hot.select(H1, H2), [H1, H2], "left_anti")
    within = F.row_number().over(Window.partitionBy(BUCKET).orderBy(H1, H2)) - 1
    starts = sizes.where(~F.col("hot")).select(BUCKET, "first")
    numbered = rows.join(starts, BUCKET).withColumn(NUMBER, F.col("first") + within).select(*values, NUMBER)
    if n_hot:
        piece = F.lit(hot_rows)
        one = keyed.join(hot.select(H1, H2), [H1, H2], "left_semi").groupBy(H1, H2).agg(F.first(F.struct(*values)).alias("row"))
        pieces = one.join(hot, [H1, H2]).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / piece) - 1))).repartition("k", H1)
        last = F.least(F.col("c"), (F.col("k") + 1) * piece) - 1
        again = pieces.withColumn("at", F.explode(F.sequence(F.col("k") * piece, last))).withColumn(NUMBER, F.col("at") + F.col("first"))
        numbered = numbered.unionByName(again.select("row.*", NUMBER))
    return numbered, n


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, hot_rows: int = 50_000) -> DataFrame:
    """``docs`` with ``shard`` in [0, shards) and ``slot``, its gapless place in the shard."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    numbered, n = number_rows(docs.select(*[f"`{c}`" for c in kept]), hot_rows)
    if n == 0:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop(NUMBER)
    place = numbered.withColumn(NUMBER, permuted(F.col(NUMBER), n, seed))
    shard = F.col(NUMBER) % F.lit(shards)
    return place.withColumns({"shard": shard.cast("int"), "slot": ((F.col(NUMBER) - shard) / F.lit(shards)).cast("long")}).drop(NUMBER)


def write_shards(sharded: DataFrame, path: str, part_rows: int = 1_000_000) -> None:
    """Writes each shard to folders ``shard=s/part=p`` of ``part_rows`` rows each, in the order of their slots.

    A task sorts one such stretch, so a shard may be larger than any task.  Columns named
    shard and part become the folders' names; a column ``part`` of the rows is replaced.
    """
    parted = sharded.withColumn("part", F.floor(F.col("slot") / part_rows))
    parted.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path)
