import numpy as np
import pytest

from rowtide.llm import embedding_graph as E
from rowtide.llm.queries import QUERIES


def brute(rows, least=0.9):
    """n_links and component by all pairs."""
    vec = [None if v is None or any(x is None for x in v) or not len(v) or not np.isfinite(np.array(v, float)).all() or not np.any(v) else np.array(v, np.float64) for _, v in rows]
    n, linked = len(rows), [set() for _ in rows]
    for d in {len(v) for v in vec if v is not None}:
        at = [i for i in range(n) if vec[i] is not None and len(vec[i]) == d]
        x = np.stack([vec[i] / np.abs(vec[i]).max() for i in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T >= least
        for p, q in zip(*np.nonzero(s)):
            if p != q:
                linked[at[p]].add(at[q])
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in linked[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, name)
        out.append((rows[i][0], len(linked[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def ours(spark, rows, kind="float", **options):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node string")
    return sorted((tuple(r) for r in E.near_duplicates(table, **options).collect()), key=repr)


def crowd(rng, centre, n, spread):
    return [(centre + rng.standard_normal(len(centre)) * spread).astype(np.float32).tolist() for _ in range(n)]


def test_groups_and_noise(spark):
    """Groups of 2 to 300 among noise, one at the edge of the threshold: all links within found components count."""
    rng = np.random.default_rng(3)
    vectors = [v for m in (2, 3, 10, 300) for v in crowd(rng, rng.standard_normal(32), m, 0.05)]
    vectors += [v for _ in range(40) for v in crowd(rng, rng.standard_normal(32), 3, 0.2)]
    vectors += rng.standard_normal((700, 32)).astype(np.float32).tolist()
    vectors += vectors[:6] + [vectors[0]] * 50
    rows = [(int(i), vectors[k]) for k, i in enumerate(rng.permutation(len(vectors)))]
    truth = brute(rows)
    found = ours(spark, rows)
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in truth)
    assert all(f[1] <= t[1] for f, t in zip(found, truth)) and ours(spark, rows, block=64) == found


def test_few_rounds_are_audited(spark):
    """Poor lists, from one order and tiny windows' worth of neighbours, are refined until the audit is content."""
    rng = np.random.default_rng(4)
    vectors = [v for _ in range(150) for v in crowd(rng, rng.standard_normal(24), 4, 0.15)] + rng.standard_normal((900, 24)).astype(np.float32).tolist()
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    points = E.distinct_points(E.named(table))
    one = E.near_graph(points, k=6, orders=1, rounds=1, most_rounds=8, audit=2000)
    truth = sum(r[1] for r in brute([*enumerate(vectors)]))
    links = one.links.groupBy().sum("links").first()[0]
    assert len(one.recalls) >= 1 and one.recalls[-1] >= 0.98 and links >= 0.97 * truth
    assert one.recalls == sorted(one.recalls)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    rows += [(10, [-1.0, 0.0]), (11, [1.0]), (12, [3.0]), (None, [1.0]), (None, [0.0, 1.0]), (13, [1e30, 1e-30, 0.0]), (14, [1e-30, 0.0, 0.0]), (None, None)]
    assert ours(spark, rows, kind) == brute(rows)
    assert ours(spark, [], kind) == []
    assert ours(spark, [(1, [1.0, 2.0])], kind) == [(1, 0, 1, True)]


def test_crowded_neighbour(spark):
    """A point that all others have as a neighbour is dealt in parts."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [*enumerate([centre.astype(np.float32).tolist(), *crowd(rng, centre, 600, 0.3)])]
    truth, found = brute(rows), ours(spark, rows)
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in truth)


def test_table(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    assert sorted((tuple(r) for r in QUERIES["op13_embedding_graph"](spark, sf).collect()), key=repr) == brute(rows)
