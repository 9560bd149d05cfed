import datetime as dt
import random

import pytest
from where import SF

from rowtide.model import EARLIEST, Position, TableRef, TableSpec
from rowtide.operators import poll
from rowtide.operators.shards import FixedShard, NotNullShard, ShardList, TimeShard
from rowtide.plans.choose import lag_of, per_shard_possible, per_shard_wanted, planned_poll

SPEC = TableSpec(TableRef("db", "t"), "ts", ("a", "b"))
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tied(spark):
    """Composite key, ties at the first, a middle and the last timestamp, a null timestamp."""
    rng, rows = random.Random(3), []
    for k, n in enumerate([9, 1, 1, 12, 2, 1, 8]):
        rows += [(T0 + dt.timedelta(hours=k), 10 * k + i // 3, i % 3, rng.choice(["x", "y", "z", None])) for i in range(n)]
    rows.append((None, 99, 0, "x"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ts timestamp_ntz, a int, b int, s string").cache()


def ordered(df):
    return [tuple(r) for r in df.collect()]


def drained(df, limit, **options):
    return [tuple(r) for batch, _ in poll.drain(df, SPEC, limit=limit, **options) for r in batch.collect()]


@pytest.mark.parametrize("limit", [1, 2, 7, 17, 34, 10_000])
def test_drain_is_the_same_at_every_limit(tied, limit):
    assert drained(tied, limit) == ordered(tied.where("ts IS NOT NULL").orderBy("ts", "a", "b"))


@pytest.mark.parametrize("limit", [1, 5])
def test_stop_and_restart_after_each_batch(tied, limit):
    position, seen = EARLIEST, []
    while True:
        step = next(iter(poll.drain(tied, SPEC, position, limit=limit)), None)
        if step is None:
            break
        batch, position = step
        seen += [tuple(r) for r in poll.poll(tied, SPEC, Position(*seen_position(seen)) if seen else EARLIEST, limit=limit).collect()]
    assert seen == ordered(tied.where("ts IS NOT NULL").orderBy("ts", "a", "b"))


def seen_position(seen):
    return seen[-1][0], seen[-1][1:3]


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_null_keys_within_a_commit(spark, limit):
    rows = [(T0, a, b, "x") for a in (None, False, True) for b in (None, 1, 2)] + [(T0 + dt.timedelta(1), None, None, "y")]
    df = spark.createDataFrame(rows[::-1], "ts timestamp_ntz, a boolean, b int, s string")
    assert drained(df, limit) == rows
    assert Position(T0, (None, 1)) <= Position(T0, (False, None)) and not Position(T0, (False, None)) <= Position(T0, (None, 1))


def test_drain_orders_with_real_ties(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderdate")
    spec = TableSpec(TableRef("db", "orders"), "o_orderdate", ("o_orderkey",))
    start = Position(dt.datetime(1998, 5, 1))
    whole = [tuple(r) for r in poll.changes(orders, spec, start).orderBy(*spec.order).collect()]
    assert [tuple(r) for b, _ in poll.drain(orders, spec, start, limit=50) for r in b.collect()] == whole


@pytest.mark.parametrize("limit", [1, 4, 100])
@pytest.mark.parametrize("values", [("x",), ("x", "y"), ("x", "y", "x", None)])
def test_plans_agree(tied, limit, values):
    shard = ShardList("s", values)
    plain = ordered(poll.poll(tied, SPEC, EARLIEST, shard, limit))
    assert ordered(poll.per_shard_poll(tied, SPEC, shard, EARLIEST, limit)) == plain
    assert ordered(poll.late_poll(tied, SPEC, shard, EARLIEST, limit)) == plain
    assert ordered(planned_poll(tied, SPEC, EARLIEST, shard, limit, True, T0)) == plain


def test_position_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    spec = TableSpec(TableRef("db", "orders"), "o_orderdate", ("o_orderkey",))
    plan = poll.poll(orders, spec, Position(dt.datetime(1998, 1, 1), (5,)), limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "TakeOrderedAndProject" in plan


def test_rest_of_commit_and_last_position(tied):
    assert poll.rest_of_commit(tied, SPEC, T0, 4).count() == 5
    assert poll.last_position(tied.where("a < 0"), SPEC) == (None, 0)
    end, n = poll.last_position(poll.poll(tied, SPEC, limit=9), SPEC)
    assert (end, n) == (Position(T0, (2, 2)), 9)


def test_shards(spark, tied):
    assert poll.changes(tied, SPEC, shard=FixedShard("s", "x")).count() == tied.where("s = 'x' AND ts IS NOT NULL").count()
    assert poll.changes(tied, SPEC, shard=NotNullShard("s")).count() == tied.where("s IS NOT NULL AND ts IS NOT NULL").count()
    assert FixedShard.of_numeric("c", "1.50").value.as_tuple().exponent == -2
    assert FixedShard.of_date("c", "2020-02-29").value == dt.date(2020, 2, 29)


@pytest.mark.parametrize(
    "now, bucket, names",
    [
        (dt.datetime(2024, 1, 1, 0, 0, 30), "DAY", ["2024-01-01", "2023-12-31"]),
        (dt.datetime(2024, 1, 1, 0, 1, 0), "DAY", ["2024-01-01"]),
        (dt.datetime(2024, 1, 1, 0, 0, 30), "YEAR", ["2024", "2023"]),
        (dt.datetime(2024, 3, 1, 0, 0, 59), "MONTH", ["24yyy-03", "24yyy-02"]),
        (dt.datetime(2024, 1, 8, 0, 0, 1), "WEEK", ["2024-02", "2024-01"]),
        (dt.datetime(2024, 1, 8, 5, 0, 44), "MINUTE_OF_HOUR", ["00", "59"]),
        (dt.datetime(2024, 1, 8, 5, 0, 45), "MINUTE_OF_HOUR", ["00"]),
    ],
)
def test_time_buckets_at_edges(now, bucket, names):
    assert TimeShard("s", bucket, now, encoded=False).names() == names


def test_time_bucket_since():
    assert len(TimeShard("s", "DAY", dt.datetime(2024, 1, 5), False, dt.datetime(2024, 1, 2)).names()) == 4


def test_plan_choice():
    many = ShardList("s", tuple(range(101)))
    assert per_shard_possible(ShardList("s", (1, 2)), 100_000) and not per_shard_possible(ShardList("s", (1, 2)), 100_001)
    assert not per_shard_possible(many, 10) and not per_shard_possible(FixedShard("s", 1), 10)
    assert per_shard_wanted(True, dt.timedelta(seconds=61)) and not per_shard_wanted(True, dt.timedelta(seconds=60))
    assert not per_shard_wanted(False, dt.timedelta(hours=1))
    now = dt.datetime(2024, 1, 2)
    assert lag_of(Position(dt.date(2024, 1, 1)), now) == lag_of(Position(dt.datetime(2024, 1, 1, tzinfo=dt.UTC)), now) == dt.timedelta(days=1)
    assert lag_of(Position(None), now) == lag_of(Position(7), now) == dt.timedelta(0)


@pytest.mark.parametrize("ahead", [1, 2, 7, 1000])
def test_drain_ahead(spark, ahead):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderdate").where("o_orderkey < 900")
    spec = TableSpec(TableRef("db", "orders"), "o_orderdate", ("o_orderkey",))
    want = [tuple(r) for r in orders.orderBy("o_orderdate", "o_orderkey").collect()]
    found, ends = [], []
    for batch, end in poll.drain(orders, spec, limit=13, ahead=ahead):
        rows = sorted((r.o_orderdate, r.o_orderkey) for r in batch.collect())
        found.append(len(rows))
        ends.append((end.ts, end.key[0]))
        assert rows[-1] == ends[-1]
    assert sum(found) == len(want) and set(found[:-1]) == {13} and ends[-1] == want[-1][::-1]
