import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinkweave.llm.vector_dedup import build, common, keys_of, near_vectors, nearest, unit


def brute(rows, threshold=0.98):
    """(n_links, component) of each row by comparing all pairs."""
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None and i is not None for i, v, label in rows]
    adj = np.zeros((n, n), bool)
    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if ok[k]:
            groups.setdefault((label, len(v)), []).append(k)
    for own in groups.values():
        m = np.array([rows[k][1] for k in own], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        adj[np.ix_(own, own)] = m @ m.T >= threshold
    np.fill_diagonal(adj, False)
    out, seen = [None] * n, set()
    for k in range(n):
        if k in seen:
            continue
        todo, part = [k], []
        seen.add(k)
        while todo:
            j = todo.pop()
            part.append(j)
            for t in np.flatnonzero(adj[j]):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (int(adj[j].sum()), least)
    return out


def compared(spark, rows, kind="float", **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("more", F.create_map(F.lit("a"), F.lit(1)))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in near_vectors(frame, **options).collect()))
    want = sorted(((i is None, i or 0, n, c or 0, i is None or i == c) for (i, _, _), (n, c) in zip(rows, brute(rows))))
    return got, want


def test_given_vectors(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = compared(spark, rows)
    assert got == want


def test_dense_groups_copies_and_borderline(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    rows = [(k, (centre + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.14])).tolist(), 1) for k in range(900)]
    rows += [(1000 + k, rng.normal(size=64).tolist(), 1 + k % 2) for k in range(600)]
    rows += [(2000 + k, rows[1000][1], rows[1000][2]) for k in range(300)]
    got, want = compared(spark, rows)
    links, wanted = sum(g[2] for g in got), sum(w[2] for w in want)
    assert 0.999 * wanted <= links <= wanted
    assert [g[3] for g in got] == [w[3] for w in want]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 0.0], 1), (9, [inf, 0.0, 0.0], 1), (10, [1.0, None, 0.0], 1), (None, one, 1), (11, [1.0, 0.0], 1), (12, [2e38, 0.0, 0.0], 1), (2, one, 1), (2, one, 1), (13, [1.0, 0.1, 0.0], 1)]
    got, want = compared(spark, rows)
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label string, component_id int")
    assert near_vectors(empty).count() == 0


def test_very_large_and_small_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (v * s).tolist(), 1) for k, v in enumerate(rng.normal(size=(40, 8))) for s in (1e200, 1e-200)]
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(frame).collect())
    scaled = brute([(i, (np.array(v) / np.abs(v).max()).tolist(), label) for i, v, label in rows])
    assert got == [(i, n, c) for (i, _, _), (n, c) in zip(rows, scaled)] and all(n >= 1 for _, n, _ in got)


def test_exact_mode(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + rng.normal(size=16) * 0.19).tolist(), k % 2) for k in range(1200)]
    got, want = compared(spark, rows, exact=True)
    assert got == want and sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("dims", [16, 64, 384])
@pytest.mark.parametrize("n", [10**4, 10**7, 10**10])
def test_recall_and_lists_projected_to_many_vectors(dims, n):
    """The index for n vectors like the sample's, tried on others: pairs at the threshold meet, and lists stay short."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, dims))
    draw = lambda k: centres[rng.integers(0, 200, k)] + rng.normal(size=(k, dims))
    index = build(draw(4000), n)
    x = unit(draw(2000))
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * unit(aside)
    a, b = nearest(x, index.pivots), nearest(y, index.pivots)
    found = (common(keys_of(a, index), keys_of(b, index)).any(1)) & (common(a, b).sum(1) >= index.shared)
    assert found.mean() >= 0.9
    other = np.mean([common(keys_of(a, index), keys_of(np.roll(a, k, axis=0), index)).any(1).mean() for k in range(1, 20)])
    print(dims, n, len(index.pivots), index.posted, index.prefix, index.shared, round(found.mean(), 4), other)
    assert other * n < max(300, n / 20)
