"""The pivot index against scoring all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kspec.llm import pivots


def brute(rows, k, is_query):
    """rows: (vec_id, vector); a list of results for each query row."""
    held = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(held):
        if q is not None and is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0, m) for m, (i, b) in enumerate(held) if m != n)
            out += [(q, r + 1, held[m][0], -s) for r, (s, _, _, m) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(spark, rows, k=10, **how):
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, row int, r double, cell int")
    got = pivots.search(pivots.build(df, **how), F.col("vec_id") % 20 == 0, k)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def clustered(rng, n, dim, clusters, norms=(0.5, 1.5)):
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(clusters, size=n)] + 0.05 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1)[:, None] * rng.uniform(*norms, size=(n, 1))).astype(np.float32)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_against_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("BLOCK", 20), ("CHUNK", 3), ("FILL", 5), ("ROUNDS", (11, 30, 90, None))):
            monkeypatch.setattr(pivots, name, value)
    rng = np.random.default_rng(5)
    v = clustered(rng, 400, 8, 12).astype(float).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[7]) for i in range(150)]  # 151 equal ones
    rows += [(None, v[0]), (2000, None), (2020, [float("nan")] * 8), (2040, [None, *v[1][1:]]), (2060, [math.inf] * 8), (2080, []), (2100, v[2][:3]), (20, v[3]), (20, v[3]), (-40, v[4]), (2**53 + 4, v[5]), (2**53 + 3, v[5])]
    assert found(spark, rows) == brute(rows, 10, lambda i: i % 20 == 0)


def test_few_and_none(spark):
    rows = [(20, [0.5, -0.25]), (1, [-0.5, 0.0001]), (2, [0.5, -0.25])]
    assert found(spark, rows) == brute(rows, 10, lambda i: i % 20 == 0)
    assert found(spark, rows[:1]) == [] and found(spark, []) == [] and found(spark, [(20, [0.0]), (3, [0.0])]) == [(20, 1, 3, 0)]


def test_products_beyond_a_double(spark):
    rows = [(20 * i, [float(2**20 + i), 3.0 * i, 1.0]) for i in range(30)]
    assert found(spark, rows) == brute(rows, 10, lambda i: i % 20 == 0)


def test_bounds_hold_and_leave_annuli(spark, monkeypatch):
    monkeypatch.setattr(pivots, "FILL", 20)
    rng = np.random.default_rng(9)
    v = clustered(rng, 3000, 6, 30, (0.95, 1.05))
    df = spark.createDataFrame([(i, x.astype(float).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = pivots.build(df)
    members = defaultdict(list)
    for p in index.points.collect():
        members[p.cell, p.ring].append(p.v)
    t = index.rings
    queries = np.floor(1024 * v[::100].astype(np.float64))
    bound = pivots.upper_bounds(queries, index.norm, index.pivots, t["cell"], t["low"], t["high"])
    scores = np.stack([(queries @ np.array(members[c, r]).T).max(axis=1) for c, r in zip(t["cell"], t["ring"], strict=True)], axis=1)
    assert (scores <= bound).all()
    tenth = np.sort(queries @ np.floor(1024 * v.astype(np.float64)).T, axis=1)[:, -11]
    assert len(t["cell"]) > 50
    assert (bound >= tenth[:, None]).mean() < 0.5
