"""Mini-batch k-means against full k-means and plain assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mosaicell.operators import cluster, kmeans


def plain(v, centers):
    d = ((v[:, None] - centers[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


def full(v, centers, steps=100):
    for _ in range(steps):
        at, _ = plain(v, centers)
        centers = np.stack([v[at == c].mean(0) if (at == c).any() else centers[c] for c in range(len(centers))])
    return plain(v, centers)[1].sum()


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell_id long, vec array<double>").repartition(4)


def blobs(n, k, dims, seed=2):
    rng = np.random.default_rng(seed)
    heart = rng.normal(0, 6, (k, dims))
    return heart[rng.integers(0, k, n)] + rng.normal(0, 1, (n, dims))


def test_tree_finds_the_nearest_center():
    for n_centers, dims in ((1, 2), (7, 3), (200, 5), (200, 40)):
        v, c = blobs(3000, 20, dims), blobs(n_centers, 9, dims, 5)
        at, d = kmeans.CenterTree(c).nearest(v)
        want, least = plain(v, c)
        assert np.allclose(d, least, atol=1e-8) and np.array_equal(at, want)
    twice = np.array([[1.0, 1.0], [0.0, 0.0], [1.0, 1.0]])
    assert kmeans.CenterTree(twice).nearest(np.array([[1.0, 1.0]]))[0].tolist() == [0]


def test_cost_is_near_that_of_full_kmeans(spark):
    v = blobs(4000, 12, 6)
    best = min(full(v, kmeans.first_centers(v, 30, s)) for s in range(3))
    for batch in (10_000, 1000):  # all in one batch, and four batches
        report: dict = {}
        c = kmeans.minibatch_kmeans(frame(spark, v), 30, batch=batch, report=report)
        assert plain(v, c)[1].sum() <= 1.03 * best, report
        assert report["batches"] == (1 if batch > 4000 else 4) and report["steps"] < 300


def test_sums_of_many_tasks_are_added_in_tasks(spark):
    v = blobs(800, 5, 3)
    tree = kmeans.CenterTree(v[:70])
    want = kmeans._moved(tree, [v])
    for many in (False, True):
        n, sums, cost, far = kmeans._distributed(frame(spark, v), tree, many)
        assert np.array_equal(n, want[0]) and np.allclose(sums, want[1]) and np.isclose(cost, want[2])
        assert np.allclose([d for d, _ in far], [d for d, _ in want[3]])


def test_tasks_without_vectors_add_nothing(spark):
    v = blobs(40, 3, 3)
    tree = kmeans.CenterTree(v[:5])
    want = kmeans._moved(tree, [v[:1]])
    for many in (False, True):  # one vector in four partitions
        n, sums, cost, far = kmeans._distributed(frame(spark, v).filter("cell_id = 0"), tree, many)
        assert np.array_equal(n, want[0]) and np.allclose(sums, want[1]) and np.isclose(cost, want[2]) and len(far) == 1


def test_metacells_hold_every_cell(spark):
    v = blobs(300, 6, 4)
    cells = frame(spark, v)
    found, centers = cluster.metacells(cells, 20, scale=False)
    c = np.array([r.vec for r in centers.orderBy("metacell").collect()])
    got = {r.cell_id: r.metacell for r in found.collect()}
    assert [got[i] for i in range(300)] == plain(v, c)[0].tolist()
    again = {r.cell_id: r.metacell for r in cluster.metacells(cells, 20, scale=False)[0].collect()}
    assert again == got
    one, center = cluster.metacells(cells, 1, scale=False)
    assert one.agg(F.max("metacell")).first()[0] == 0 and np.allclose(center.first().vec, v.mean(0))
    same = frame(spark, np.ones((30, 2)))
    assert cluster.metacells(same, 5)[0].count() == 30
    assert cluster.metacells(cells.limit(0), 5)[0].count() == 0
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [5.0, 5.0])], "cell_id long, vec array<double>")
    assert {r.cell_id for r in cluster.metacells(odd, 2)[0].collect()} == {1, 5}
