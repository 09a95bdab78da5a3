"""Tiled comparison of embeddings, against all pairs in plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("orrery.llm")

from orrery.llm import embedding_dedup as dedup  # noqa: E402


def brute(rows, threshold):
    """(n_links, component_id) of each row, by all pairs."""
    def fine(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, name = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, (a, u) in enumerate(rows):
        for j in range(i):
            b, v = rows[j]
            if fine(a, u) and fine(b, v) and len(u) == len(v):
                p, q = (np.array(x, float) / max(map(abs, x)) for x in (u, v))
                if math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q)) >= threshold:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    x, y = sorted((root(i), root(j)))
                    name[y] = x
    groups = {}
    for i, (a, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(a)
    return [(n[i], min(groups[root(i)], key=lambda x: (x is None, x or 0))) for i in range(len(rows))]


def cloud(rng, n, d):
    """Random vectors with copies, groups of near copies and chains of neighbours."""
    out = [rng.normal(size=d) for _ in range(n)]
    for base in out[:5]:
        out += [base * s for s in (1.0, 1.0, 3.0)]
        out += [base + rng.normal(size=d) * 0.12 for _ in range(25)]
    step = out[7] / np.linalg.norm(out[7])
    for _ in range(25):  # a chain: each is linked with its neighbours only
        side = rng.normal(size=d)
        side -= side @ step * step
        step = step * math.cos(0.3) + side / np.linalg.norm(side) * math.sin(0.3)
        out.append(step)
    return [x.astype(np.float32).tolist() for x in out]


@pytest.mark.parametrize(("d", "small_tiles"), [(6, False), (40, True), (70, False)])
def test_near_vectors(spark, monkeypatch, d, small_tiles):
    rng = np.random.default_rng(d)
    if small_tiles:  # many tiles of few vectors, many blocks in each
        monkeypatch.setattr(dedup, "TILE_BYTES", 20 * d * 4)
        monkeypatch.setattr(dedup, "BLOCK", 7)
    vectors = cloud(rng, 150, d)
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[k]) for i, k in enumerate(order)]
    frame = spark.createDataFrame([(*r, 5, 1) for r in rows], "vec_id long, embedding array<float>, node int, size int").repartition(3)
    got = {r.vec_id: r for r in dedup.near_vectors(frame).collect()}
    want = brute(rows, 0.95)
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == want
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values()) and sum(n for n, _ in want) > 300


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.0, 0.0]), (6, []), (7, None), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 0.0]), (11, [1e-300, 0.0]), (12, [-1.0, 0.0]), (13, [-0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in dedup.near_vectors(frame).collect()), key=str)
    want = [(i, n, c if i is not None else None) for (i, _), (n, c) in zip(rows, brute(rows, 0.95), strict=True)]
    assert got == sorted(want, key=str)
    assert dedup.near_vectors(frame.limit(0)).count() == 0
    alone = frame.where("vec_id in (3, 5)")
    assert sorted(r.n_links for r in dedup.near_vectors(alone).collect()) == [0, 0]


def test_pairs_exactly_at_the_threshold(spark):
    # 19 / 20 is the threshold itself: squares 20 and 20, product 19
    rows = [(1, [4.0, 1.0, 1.0, 1.0, 1.0]), (2, [4.0, 1.0, 1.0, 1.0, 0.0]), (3, [3.0, 3.0, 1.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for t in (0.95, 19 / math.sqrt(20 * 19)):
        want = brute(rows, t)
        got = {r.vec_id: r.n_links for r in dedup.near_vectors(frame, t).collect()}
        assert got == {i: n for (i, _), (n, _) in zip(rows, want, strict=True)}
    assert got[1] == 1


def test_bounds_drop_no_linked_pair():
    rng = random.Random(4)
    for _ in range(20):
        x = np.array([[rng.gauss(0, 1) * 0.8**k for k in range(48)] for _ in range(60)])
        x = np.vstack([x, x + np.random.default_rng(1).normal(size=x.shape) * 0.1])
        nodes = np.arange(len(x), dtype=np.int64).tobytes()
        side = dedup.Side(nodes, nodes, x.tobytes(), 48, {48: np.eye(48)}, np.float64)
        u = dedup.units(x)
        i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
        rows, cols = dedup.open_block(side, side, np.arange(len(x)), np.arange(len(x)), 0.95)
        assert set(i) <= set(rows) and set(j) <= set(cols)


def test_far_tiles_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE_BYTES", 50 * 8 * 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.05).astype(np.float32).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "node long, embedding array<float>").withColumn("size", F.lit(1).cast("long"))
    turn = dedup.directions(frame)
    made = dedup.tiles(frame, turn, 0.316)
    n = made.count()
    assert sum(len(r.nodes) // 8 for r in made.collect()) == 600 and all(len(r.data) <= 50 * 8 * 4 for r in made.collect())
    assert n <= dedup.meetings(made, 0.316).count() < n * (n + 1) // 2
