import numpy as np
import pytest

from trackloom.llm import embedding_dedup
from trackloom.llm.embedding_dedup import near_vectors


def brute(ids, x, threshold=0.95):
    norm = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {(int(d), int(link[i].sum()), int(label[i]), bool(label[i] == d)) for i, d in enumerate(ids)}


@pytest.mark.parametrize("block", [64, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "LEAF", 100)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    near = x[:200] + 0.05 * rng.standard_normal((200, 16))
    cluster = x[0] + 0.08 * rng.standard_normal((150, 16))
    x = np.concatenate([x, near, cluster, x[:40]]).astype(np.float32)
    ids = list(range(1, len(x) + 1))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in near_vectors(frame).collect()}
    want = brute(ids, x.astype(np.float64))
    assert len(got - want) <= 0.002 * len(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [1e300, 0.0]), (8, [0.0, 1.0]), (9, []), (10, [1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (12, [float("inf"), 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, node int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()))
    assert got == [(0, 3, 5, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False), (8, 1, 8, True), (8, 1, 8, True), (9, 0, 9, True), (10, 0, 10, True), (12, 0, 12, True)]


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_large_groups_without_background(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((2, 64))
    x = np.repeat(centre, 2000, axis=0) + 0.2 * rng.standard_normal((4000, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, near_vectors(frame).collect()))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = np.array([g[1] for g in got])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert {g[2] for g in got} == {0, 2000}


@pytest.mark.parametrize("n, sampled", [(20_000, 40_000), (100_000, 40_000), (100_000, 3_000)])
def test_recall_of_the_forest(n, sampled):
    """Pairs planted just above the threshold, with production parameters; the forest alone, without Spark."""
    rng = np.random.default_rng(n)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((n, 64)))
    y = rng.standard_normal((1000, 64))
    y = unit(y - (y * x[:1000]).sum(axis=1, keepdims=True) * x[:1000])
    x = np.concatenate([x, 0.951 * x[:1000] + (1 - 0.951**2) ** 0.5 * y])
    trees = embedding_dedup.grow(embedding_dedup._quantised(x[rng.permutation(len(x))[:sampled]], 64), len(x), 0.95)
    row, leaf = embedding_dedup._all_leaves(trees, x)
    held = [set() for _ in x]
    for r, f in zip(row.tolist(), leaf.tolist(), strict=True):
        held[r].add(f)
    assert np.mean([not held[i].isdisjoint(held[n + i]) for i in range(1000)]) > 0.98
    # what bounds the work: copies of a vector, and rows of a leaf
    assert len(row) < 16 * len(x) and np.unique(leaf, return_counts=True)[1].max() < 3 * embedding_dedup.LEAF
