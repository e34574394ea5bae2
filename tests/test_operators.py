"""Analytic and brute-force tests of what SQL can't check."""

from __future__ import annotations

import itertools
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicell.functions import communities, numeric
from mosaicell.operators import composition, factorize, graph, mapping, neighbors, preprocess, scales, spectral, subcluster
from mosaicell.plans import storage


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs], "src long, dst long, weight double")


def points_of(spark, xy, ids=None):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids or range(len(xy)), xy, strict=True)], "cell_id long, x double, y double")


@pytest.mark.parametrize("few", [0, 4000])
def test_knn_ties_duplicates_and_far_points(spark, few):
    xy = [(0, 0), (0, 0), (0, 0), (1, 0), (1000, 1000), (2, 0), (0, 1)]
    got = {}
    for r in neighbors.knn(points_of(spark, xy), 2, few).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i, (x, y) in enumerate(xy):
        want = sorted((math.hypot(x - a, y - b), j) for j, (a, b) in enumerate(xy) if j != i)[:2]
        assert [d for _, d in sorted(got[i])] == [j for _, j in want]


def test_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PART", 30)
    p = points_of(spark, np.random.default_rng(8).normal(size=(300, 2)) ** 3)
    assert sorted(map(tuple, neighbors.knn(p, 7, 0).collect())) == sorted(map(tuple, neighbors.knn(p, 7).collect()))


def nearest_of(v, k):
    found = set()
    for i in range(len(v)):
        away = v - v[i]
        d = np.sqrt((away * away).sum(1))
        d[i] = np.inf
        found |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(len(v)), d))[:k])}
    return found


@pytest.mark.parametrize("blocks", [(4096, 2048), (50, 40)])
def test_knn_of_crowds_and_copies(spark, monkeypatch, blocks):
    """Half of the points in a thousandth of the area, a sixth at one place."""
    monkeypatch.setattr(neighbors, "TARGETS", blocks[0])
    monkeypatch.setattr(neighbors, "ASKING", blocks[1])
    monkeypatch.setattr(neighbors, "PART", 100)
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.random((400, 2)), 0.3 + 0.03 * rng.random((600, 2)), np.tile([[0.5, 0.5]], (200, 1))])
    report = {}
    got = {(r.src, r.dst, r["rank"]) for r in neighbors.knn(points_of(spark, xy), 5, 0, report).collect()}
    assert got == nearest_of(xy, 5) and report["parts"] >= 8
    assert report["own"] + report["others"] < len(xy) ** 2 / 3


def test_tiles_follow_the_points():
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.random((4000, 2)), 0.3 + 0.01 * rng.random((4000, 2))])
    tiles = neighbors.Tiles(v[::4], 32)
    sizes = np.bincount(tiles.assign(v)[0], minlength=32)
    assert len(tiles.boxes) == 32 and sizes.max() <= 2 * np.median(sizes)
    part, _ = tiles.assign(v)
    assert ((v >= tiles.boxes[part, :, 0]) & (v < tiles.boxes[part, :, 1])).all()
    assert len(neighbors.Tiles(np.ones((50, 2)), 9).boxes) == 1


def test_knn_vectors_by_pivots(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(40, 6))[rng.integers(40, size=1500)] * 10 + rng.normal(size=(1500, 6))
    v[300:700] = v[0]  # copies
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "cell_id long, vec array<double>")
    report = {}
    got = {(r.src, r.dst, r["rank"]) for r in neighbors.knn_vectors(p, 4, 0, report).collect()}
    assert got == nearest_of(v, 4)
    assert report["parts"] > 10 and report["own"] + report["others"] < len(v) ** 2 / 5
    few = {(r.src, r.dst, r["rank"]) for r in neighbors.knn_vectors(p.filter("cell_id % 9 = 0"), 3).collect()}
    ids = np.arange(0, 1500, 9)
    assert few == {(int(ids[a]), int(ids[b]), n) for a, b, n in nearest_of(v[ids], 3)}
    assert neighbors.knn_vectors(p.limit(0), 3).count() == 0 and neighbors.knn_vectors(p.filter("cell_id = 3"), 3).count() == 0


@pytest.mark.parametrize("crowd,block", [(1024, 2048), (5, 30), (40, 2048)])
def test_density_and_radius_join_of_crowds(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = np.random.default_rng(10)
    xy = np.concatenate([rng.random((200, 2)), 0.3 + 0.03 * rng.random((300, 2)), np.tile([[0.31, 0.31]], (60, 1))])
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    p = points_of(spark, xy)
    for radius in (0.012, 0.1, 3.0):
        assert {r.cell_id: r.density for r in neighbors.density(p, radius, crowd).collect()} == dict(enumerate((near <= radius).sum(1).tolist()))
    assert {(r.src, r.dst) for r in neighbors.radius_join(p, p, 0.02).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(near <= 0.02)), strict=True))


def test_density_beside_crowds_is_dealt_to_tasks(spark):
    """String ids, NaN and null places; what bytes alone would put in one task has several."""
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.random((700, 2)), 0.5 + 0.02 * rng.random((150, 2))])
    rows = [(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("nan", float("nan"), 0.5), ("none", None, 0.5)]
    df = neighbors.density(spark.createDataFrame(rows, "cell_id string, x double, y double"), 0.1, 60)
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= 0.1
    assert {r.cell_id: r.density for r in df.collect()} == {f"c{i}": n for i, n in enumerate(near.sum(1).tolist())}
    plan = df._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "FlatMapCoGroupsInArrow" in plan


def test_knn_of_one_or_no_point(spark):
    assert neighbors.knn(points_of(spark, [(1, 1)]), 3).count() == 0
    assert neighbors.knn(points_of(spark, []), 3).count() == 0


def test_weights_are_capped_at_zero_distance(spark):
    e = graph.weigh(neighbors.knn(points_of(spark, [(0, 0), (0, 0), (3, 4)]), 1))
    assert {round(r.weight, 6) <= 100 for r in e.collect()} == {True}
    with pytest.raises(ValueError):
        graph.weigh(e, "nothing")


@pytest.mark.parametrize("path", ["local", "joins"])
def test_heat_filter_equals_dense_solution(spark, path):
    rng = np.random.default_rng(3)
    n = 12
    pairs = [(i, (i + 1) % n, float(w)) for i, w in enumerate(rng.uniform(0.5, 3, n))] + [(0, 6, 2.0)]
    x = rng.normal(size=(n, 2))
    lap = np.zeros((n, n))
    for a, b, w in pairs:
        lap[a, b] -= w
        lap[b, a] -= w
        lap[a, a] += w
        lap[b, b] += w
    top = float(values[-1] * 1.01)
    signals = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)] + [(99, [5.0, 6.0])], "cell_id long, vec array<double>")
    out = spectral.heat_filter(edges_of(spark, pairs), signals, [0.0, 2.0, 20.0], order=30 if path == "local" else 14, lmax=top, path=path)
    for r in out.collect():
        if r.cell_id == 99:
            assert list(r.vec) == [5.0, 6.0]
            continue
        want = vectors @ np.diag(np.exp(-r.scale * values / top)) @ vectors.T @ x
        assert np.allclose(r.vec, want[r.cell_id], atol=1e-6 if path == "local" else 1e-3)


def test_heat_filter_by_tiles_equals_local(spark, monkeypatch):
    rng = np.random.default_rng(13)
    p = points_of(spark, rng.random((400, 2)))
    rows = graph.symmetrize(graph.weigh(neighbors.knn(p, 4), k=4)).collect()
    edges = spark.createDataFrame(rows)
    signals = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(402)], "cell_id long, vec array<double>")
    p = p.unionByName(points_of(spark, [(0.5, 0.5), (9, 9)], [400, 401]))
    exchanges, terms = [], spectral._terms
    monkeypatch.setattr(spectral, "TILE_CELLS", 50)
    monkeypatch.setattr(spectral, "_terms", lambda *a: (exchanges.append(a), terms(*a))[1])
    want = {(r.cell_id, r.scale_idx): r.vec for r in spectral.heat_filter(edges, signals, [0.0, 1.5, 20.0], path="local").collect()}
    got = spectral.heat_filter(edges, signals, [0.0, 1.5, 20.0], path="tiles", points=p).collect()
    assert len(got) == 3 * 402 and len(exchanges) == 6
    assert all(np.allclose(r.vec, want[r.cell_id, r.scale_idx], atol=1e-12) and r.scale == [0.0, 1.5, 20.0][r.scale_idx] for r in got)
    for order in (0, 1, 7, 11):
        want = {r.cell_id: r.vec for r in spectral.heat_filter(edges, signals, [2.0], order, "bound", "local").collect()}
        assert all(np.allclose(r.vec, want[r.cell_id], atol=1e-12) for r in spectral.heat_filter(edges, signals, [2.0], order, "bound", "tiles", p).collect())
    same = spectral.heat_filter(edges.limit(0), signals, [2.0], path="tiles", points=p).collect()
    assert {r.cell_id: r.vec for r in same} == {r.cell_id: r.vec for r in signals.collect()}


def test_heat_filter_keeps_mass_and_constants(spark):
    pairs = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0)]
    signals = spark.createDataFrame([(i, [1.0, float(i == 1)]) for i in range(4)], "cell_id long, vec array<double>")
    out = spectral.heat_filter(edges_of(spark, pairs), signals, [3.0]).collect()
    assert np.allclose([r.vec[0] for r in out], 1) and abs(sum(r.vec[1] for r in out) - 1) < 1e-9


def test_largest_eigenvalue(spark):
    e = edges_of(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    assert abs(spectral.largest_eigenvalue(e) / 1.01 - (2 + math.sqrt(2))) < 0.02
    assert spectral.eigen_bound(e) >= 2 + math.sqrt(2)


@pytest.mark.parametrize("local", [10**6, 0])
def test_lanczos_of_a_neighbour_graph(spark, local):
    p = points_of(spark, np.random.default_rng(11).random((300, 2)))
    rows = graph.symmetrize(graph.weigh(neighbors.knn(p, 6), k=6)).collect()
    lap = np.zeros((300, 300))
    for r in rows:
        lap[r.src, r.src] += r.weight
        lap[r.src, r.dst] -= r.weight
    e = spark.createDataFrame(rows)
    top, report = np.linalg.eigvalsh(lap)[-1], {}
    got = spectral.largest_eigenvalue(e, local_edges=local, report=report)
    assert 0.995 * top <= got / 1.01 <= top * (1 + 1e-9) and report["passes"] <= spectral.PASSES
    assert spectral.largest_eigenvalue(e.limit(0), local_edges=local) == 0


def test_default_scales():
    assert len(spectral.DEFAULT_SCALES) == 58 and spectral.DEFAULT_SCALES[0] == 0.01 and spectral.MAPPING_SCALES[0] == 0.0


def test_blocks_equal_brute_force():
    rng = np.random.default_rng(0)
    m = rng.uniform(size=(7, 7))
    m = (m + m.T) / 2
    for k in (1, 2, 3, 4):
        best = min(sum(np.var(m[a:b, a:b]) for a, b in zip((0, *c), (*c, 7), strict=True)) for c in itertools.combinations(range(1, 7), k - 1))
        assert abs(scales.best_blocks(m, k)[0] - best) < 1e-12


def test_scales_of_a_block_matrix():
    m = np.kron(np.eye(3), np.ones((3, 3)))
    blocks, picked = scales.pick_scales(m, list(range(9)), 2, 6)
    assert blocks == [(0, 2), (3, 5), (6, 8)] and {0, 3, 6} <= {i for i, _ in picked}


def test_constant_component_gives_null_correlation(spark):
    rows = [(i, s, [float(i + s), 1.0]) for i in range(5) for s in range(2)]
    df = spark.createDataFrame(rows, "cell_id long, scale_idx int, vec array<double>")
    assert all(r["corr"] is None for r in scales.scale_correlation(df).collect())


def test_range_finder_equals_svd(spark):
    rng = np.random.default_rng(14)
    x = rng.poisson(0.3, (300, 120)) * rng.gamma(1, 1, 120) + np.outer(rng.random(300), rng.random(120)) * 3
    rows = spark.createDataFrame([(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)], "cell_id long, idx array<int>, val array<double>")
    mean, std, report = x.mean(0), x.std(0, ddof=1), {}
    for m, s in ((np.zeros(120), np.ones(120)), (mean, np.ones(120)), (mean, std)):
        values, vectors = factorize.principal(rows, 120, 6, m, s, report=report)
        _, top, right = np.linalg.svd((x - m) / s)
        assert np.allclose(values, top[:6] ** 2, rtol=1e-9) and report["width"] <= 120 and report["passes"] <= factorize.PASSES
        assert np.allclose(np.abs((right[:6] * vectors.T).sum(1)), 1, atol=1e-6)
    n, total, squares = factorize.moments(rows, 120)
    assert n == 300 and np.allclose(total, x.sum(0)) and np.allclose(squares, (x * x).sum(0))


def test_first_picks_look_at_few_points(spark, monkeypatch):
    seen, picks = [], mapping.poisson_disk
    monkeypatch.setattr(mapping, "poisson_disk", lambda df, *a: (seen.append(df.count()), picks(df, *a))[1])
    p = points_of(spark, np.random.default_rng(12).uniform(0, 100, (3000, 2)))
    whole = [r.cell_id for r in picks(p, 2.0).orderBy("priority").limit(20).collect()]
    assert [r.cell_id for r in picks(p, 2.0, target_n=20).orderBy("priority").collect()] == whole and seen == [80]
    seen.clear()
    # too near to each other to hold as many: the look widens, in the end to all points
    assert picks(p, 40.0, target_n=2000).count() < 20 and seen == [3000]
    assert picks(p, 2.0, target_n=0).count() == 0


def test_knee():
    x = list(range(1, 11))
    assert numeric.knee(x, [1 / v for v in x]) in (2, 3)
    assert numeric.knee(x, [1.0] * 10) is None


def test_erfc_gamma_and_t_tail(spark):
    values = [0.0, 1e-3, 0.5, -0.7, 2.0, 2.5, 2.51, 5.0, 25.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", numeric.erfc("x").alias("e"), numeric.lgamma(F.abs("x") + 0.25).alias("g")).collect():
        assert abs(r.e - math.erfc(r.x)) <= 1e-12 * math.erfc(r.x) and abs(r.g - math.lgamma(abs(r.x) + 0.25)) < 1e-11
    assert [r.e for r in spark.sql("SELECT double('nan') AS x UNION ALL SELECT null").select(numeric.erfc("x").alias("e")).collect()] == [None, None]
    rows = [(12.706204736432095, 1.0, 0.05), (2.2281388519649385, 10.0, 0.05), (1.9599639845400545, 1e5, 0.0500027729), (0.0, 5.0, 1.0), (1.0, None, None), (1.0, 0.0, None), (1.0, 1.0, 0.5)]
    for r in spark.createDataFrame(rows, "t double, df double, p double").withColumn("q", numeric.t_two_sided("t", "df")).collect():
        assert r.q == r.p if r.p is None else abs(r.q - r.p) < 1e-9


@pytest.mark.parametrize("serial", [10**6, 0])
@pytest.mark.parametrize("order", ["random", "raster"])
def test_poisson_disk_equals_serial_greedy(spark, order, serial):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 10, (150, 2))
    p = points_of(spark, xy)
    ranked = [r.cell_id for r in mapping.sampling_priority(p, order).orderBy("priority").collect()]
    want = []
    for i in ranked:
        if all(np.hypot(*(xy[i] - xy[j])) >= 1.2 for j in want):
            want.append(i)
    got = {r.cell_id for r in mapping.poisson_disk(p, 1.2, order, serial=serial).collect()}
    assert got == set(want)
    if serial:
        first = [r.cell_id for r in mapping.poisson_disk(p, 1.2, order, target_n=5).collect()]
        assert first == want[:5] and mapping.poisson_disk(p.limit(0), 1.2, order).count() == 0
    with pytest.raises(ValueError):
        mapping.sampling_priority(p, "sideways")


def test_rounds_do_not_repeat_points(spark):
    p = points_of(spark, np.random.default_rng(1).uniform(0, 10, (120, 2)))
    rows = mapping.sample_rounds(p, 2.0, 60, first_round_n=20).collect()
    assert len({r.cell_id for r in rows}) == len(rows) and max(r.round for r in rows) > 1


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(2)
    d, v = np.sort(rng.uniform(0, 9, 12)), rng.uniform(0, 1, 12)
    rows = [(1, i, float(a), 1.0, float(b)) for i, (a, b) in enumerate(zip(d, v, strict=True))] + [(2, 0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "seed_id long, nbr_id long, distance double, scale double, intensity double")
    got = {r.bin: r.value for r in mapping.interpolate(df, 10, 1).collect()}
    centers = np.arange(10) + 0.5
    want = np.interp(centers, d, v, left=np.nan, right=np.nan)
    assert set(got) == {i for i in range(10) if not np.isnan(want[i])}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_scale_zero_row_is_a_delta(spark):
    rows = [(1, i, float(i), s, 1.0 / (1 + i)) for i in range(6) for s in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "seed_id long, nbr_id long, distance double, scale double, intensity double")
    h, e = mapping.heatmap(df, 5, 1, counts_weight=False)
    zero = sorted((r.bin, r.value) for r in h.filter("scale = 0").collect())
    assert zero == [(0, 1.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    assert {r.scale: r.distance for r in e.collect()}[0.0] == 0.0
    assert abs(sum(r.value for r in h.filter("scale = 1").collect()) - 1) < 1e-9


def test_density_peaks_find_two_blobs(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (40, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)], "cell_id long, vec array<double>")
    labels = {r.cell_id: r.label for r in subcluster.density_peaks(df, 2).collect()}
    for part in (range(40), range(40, 80)):
        assert len({labels[i] for i in part} - {-1}) == 1


def test_rank_sums_with_ties_and_zeros(spark):
    values = {0: 0.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 0.0, 5: 3.0}
    expr = spark.createDataFrame([(c, "g", v) for c, v in values.items() if v], "cell_id long, gene string, value double")
    groups = spark.createDataFrame([(c, "a" if c < 3 else "b") for c in values], "cell_id long, grp string")
    z = {r.grp: r.score for r in subcluster.rank_genes(expr, groups, False).collect()}
    rank = {0: 1.5, 4: 1.5, 1: 3.5, 2: 3.5, 3: 5.0, 5: 6.0}
    want = (sum(rank[c] for c in (0, 1, 2)) - 3 * 7 / 2) / math.sqrt(3 * 3 * 7 / 12)
    assert abs(z["a"] - want) < 1e-12 and abs(z["a"] + z["b"]) < 1e-12


def test_components_and_leiden():
    src = [0, 1, 2, 3, 4, 5, 0, 3, 2]
    dst = [1, 2, 0, 4, 5, 3, 2, 5, 3]
    s, d = np.array(src + dst), np.array(dst + src)
    w = np.ones(len(s))
    labels = communities.leiden(6, s, d, w)
    assert len(set(labels[:3])) == 1 and len(set(labels[3:])) == 1 and labels[0] != labels[3]
    assert communities.modularity(s, d, w, labels) > communities.modularity(s, d, w, np.arange(6))


def test_composition_rows_sum_to_one(spark):
    e = edges_of(spark, [(0, 1, 1.0), (0, 2, 3.0), (1, 2, 1.0)])
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "cell_id long, label string")
    rows = composition.composition(e, labels).collect()
    for i in range(3):
        assert abs(sum(r.p for r in rows if r.src == i) - 1) < 1e-12
    assert {(r.label, r.p) for r in rows if r.src == 0} == {("b", 0.25), (None, 0.75)}


def small_counts(spark):
    rng = np.random.default_rng(0)
    w, h = rng.gamma(1, 1, (60, 3)), rng.gamma(1, 1, (3, 12))
    x = rng.poisson(w @ h)
    return x, spark.createDataFrame([(int(i), f"g{j:02d}", float(x[i, j])) for i in range(60) for j in range(12) if x[i, j]], "cell_id long, gene string, value double")


def test_nmf_is_nonnegative_and_improves(spark):
    x, expr = small_counts(spark)
    scores, load, losses = factorize.nmf(expr, 3, 12)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:], strict=False))
    assert losses[-1] < 0.3 * (x**2).sum()
    assert min(v for r in scores.collect() for v in r.vec) >= 0 and min(v for r in load.collect() for v in r.vec) >= 0


def test_pca_equals_svd(spark):
    x, expr = small_counts(spark)
    scores, _, variance = factorize.pca(expr, 3)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(variance, s[:3] ** 2 / 59)
    got = np.array([r.vec for r in scores.orderBy("cell_id").collect()])
    assert np.allclose((got**2).sum(0), s[:3] ** 2)


def test_harmony_mixes_batches(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(120, 3)) + 5
    b = np.arange(120) % 2
    z[b == 1] += [2, -2, 1]
    scores = spark.createDataFrame([(i, [float(v) for v in z[i]]) for i in range(120)], "cell_id long, vec array<double>")
    batches = spark.createDataFrame([(i, str(b[i])) for i in range(120)], "cell_id long, batch string")
    out = np.array([r.vec for r in factorize.harmony(scores, batches).orderBy("cell_id").collect()])
    gap = lambda v: np.linalg.norm(v[b == 0].mean(0) - v[b == 1].mean(0))
    assert gap(out) < 0.3 * gap(z)


def test_unknown_options_are_errors(spark):
    _, expr = small_counts(spark)
    for call in (lambda: factorize.reduce_dimensions(expr, "tSNE"), lambda: factorize.reduce_dimensions(expr, "NMF_harmony"), lambda: preprocess.nonnegative(expr, "wrap")):
        with pytest.raises(ValueError):
            call()


def test_streaming_counts_equal_batch(spark, tmp_path):
    from mosaicell.streaming import density

    p = points_of(spark, np.random.default_rng(0).uniform(0, 5, (50, 2)))
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = density.grid_counts(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 1.0)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("grid").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("grid").collect())) == sorted(map(tuple, density.grid_counts(p, 1.0).collect()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_whole_queries_take_all_points(spark):
    from mosaicell import queries

    d = "/root/testdata/sf0.001"
    p = queries.points(spark, d).select("cell_id", "x", "y").toPandas()
    near = np.hypot(p.x.to_numpy()[:, None] - p.x.to_numpy(), p.y.to_numpy()[:, None] - p.y.to_numpy()) <= 0.1
    assert queries.QUERIES["radius_join"](spark, d).count() == near.sum()
    assert queries.QUERIES["manifest_join"](spark, d).select("seed_id").distinct().count() == len(p)
    assert not any("% 25" in sql or "% 50" in sql for sql in queries.ORACLE_SQL.values())


def test_density_peaks_in_a_plane_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(6, 0.5, (120, 2)), [[60.0, 1.0], [0.0, 0.0], [0.0, 0.0]]])
    p = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)], "cell_id long, vec array<double>")
    want = {r.cell_id: (round(r.rho, 9), round(r.delta, 9), r.parent) for r in subcluster._paired_tree(p, len(xy), None).collect()}
    for few in (1000, 5):
        monkeypatch.setattr(subcluster, "FEW_OPEN", few)
        got = {r.cell_id: (round(r.rho, 9), round(r.delta, 9), r.parent) for r in subcluster._planar_tree(p, len(xy), None).collect()}
        assert got == want
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "cell_id long, vec array<double>")
    assert {r.label for r in subcluster.density_peaks(same).collect()} == {-1}
    assert subcluster.density_peaks(same.limit(0)).count() == 0


def test_density_peaks_of_vectors_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 1, (70, 5)), rng.normal(4, 0.5, (60, 5)), [[0.0] * 5, [0.0] * 5, [30.0] * 5]])
    n = len(v)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell_id long, vec array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    d /= d.max()
    rho = (d < np.sort(d, 1)[:, max(n // 100, 1)].mean()).sum(1) - 1 + (np.arange(n) * 2654435761 % 2**32) / 2**32 * 1e-5
    up = np.where(rho[None] > rho[:, None], d, np.inf)
    peak = rho.argmax()
    delta, parent = up.min(1), up.argmin(1)
    delta[peak], parent[peak] = d[peak].max(), peak
    want = {i: (round(rho[i], 9), round(delta[i], 9), parent[i]) for i in range(n)}
    for block in (2048, 25):  # one block, and six
        monkeypatch.setattr(subcluster, "BLOCK", block)
        got = {r.cell_id: (round(r.rho, 9), round(r.delta, 9), r.parent) for r in subcluster._paired_tree(p, n, None).collect()}
        assert got == want
    labels = {r.cell_id: r.label for r in subcluster.density_peaks(p, 2).collect()}
    assert len({labels[i] for i in range(70)} - {-1}) == len({labels[i] for i in range(70, 130)} - {-1}) == 1
    assert subcluster.density_peaks(p.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(5)], "cell_id long, vec array<double>")
    assert {r.label for r in subcluster.density_peaks(same).collect()} == {-1}


def test_diameter_of_hulls(spark):
    rng = np.random.default_rng(1)
    for xy in (rng.normal(0, 1, (500, 2)), np.zeros((4, 2)), np.stack([np.arange(9.0), np.arange(9.0)], 1), np.array([[1.0, 2.0]])):
        p = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double")
        assert abs(subcluster.diameter(p) - np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)).max()) < 1e-12


def test_knn_of_outliers_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 1, (400, 2)), [[1e6, 0.0], [-3e5, 2e5], [1e6, 1.0]]])
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell_id long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), k + 1) for i in range(len(xy)) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    for part in (1000, 20):
        monkeypatch.setattr(neighbors, "PART", part)
        assert {(r.src, r.dst, r["rank"]) for r in neighbors.knn(p, 4, few=0).collect()} == want


def test_scale_correlation_leaves_incomplete_cells_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 3, 4)) + 1e4
    rows = [(i, s, x[i, s].tolist()) for i in range(60) for s in range(3)] + [(99, 0, [0.0] * 4)]
    got = {(r.s1, r.s2): r["corr"] for r in scales.scale_correlation(spark.createDataFrame(rows, "cell_id long, scale_idx int, vec array<double>").repartition(5)).collect()}
    for a in range(3):
        for b in range(a, 3):
            want = np.mean([np.corrcoef(x[:, a, c], x[:, b, c])[0, 1] for c in range(4)])
            assert abs(got[a, b] - want) < 1e-8


# ------------------------------------------------------------------ sinks and reports


def cells_of(spark, n=240):
    """Two labels in space; label A splits in two in its layout, more so at larger scales."""
    rng = np.random.default_rng(9)
    cells, layouts, counts, shapes = [], [], [], []
    for i in range(n):
        label, half = ("A" if i % 3 else "B"), i % 2
        cells.append((i, float(rng.normal(3 * (label == "B") + half, 0.4)), float(rng.normal(0, 1)), label))
        for title, gap in (("Raw", 0.5), ("scale1.0", 3.0), ("scale2.0", 8.0)):
            layouts.append((title, i, float(rng.normal(gap * half * (label == "A"), 0.3)), float(rng.normal(0, 0.3))))
        for g in range(6):
            value = float(rng.poisson(1 + 4 * (g == half and label == "A") + 2 * (g == 2 and label == "A")))
            if value:
                counts.append((i, f"g{g}", value))
        shapes.append((i, float(rng.normal(5 * half, 1)), float(rng.normal(0, 1))))
    make = spark.createDataFrame
    return make(cells, "cell_id long, x double, y double, label string"), make(layouts, "title string, cell_id long, u1 double, u2 double"), make(counts, "cell_id long, gene string, value double"), make(shapes, "cell_id long, area double, noise double")


def test_subcluster_reports_and_their_files(spark, tmp_path):
    from mosaicell.plans.subcluster import SubclusterAnalysis

    cells, layouts, counts, shapes = cells_of(spark)
    run = SubclusterAnalysis(cells, layouts, preprocess.preprocess(counts).drop("counts"), str(tmp_path))
    with pytest.raises(ValueError):
        run.detect_subclusters()
    run.calculate_metrics()
    assert run.suggested_cluster() == "A"
    run.selected = "A"
    found = {r.cell_id: r["sub"] for r in run.detect_subclusters(2, ward=True).collect()}
    assert len(set(found.values())) == 2 and all(len({s for i, s in found.items() if i % 2 == h}) == 1 for h in (0, 1))
    costs = {r.scale: r.cost for r in run.ward_costs.collect()}
    assert costs[2.0] > costs[1.0] > costs[0.0]
    every = run.deg_analysis_subclusters(all_genes=True).collect()
    own = {g: max((r for r in every if r.gene == g), key=lambda r: r.score).grp for g in ("g0", "g1")}
    assert own["g0"] != own["g1"] and all(r.logfc > 0 for r in every if r.gene in own and r.grp == own[r.gene])
    written = spark.read.csv(str(tmp_path / "DEGs"), header=True)
    assert written.count() == len(every) and {"gene", "parent_logfc", "grp"} <= set(written.columns)
    kept = {r.gene for r in run.deg_analysis_subclusters().collect()}
    assert {"g0", "g1", "g2"} <= kept <= {r.gene for r in every}
    dots = run.dot_plot(2).collect()
    assert {r.grp for r in dots} == set(found.values()) and all(0 <= r.fraction <= 1 for r in dots)
    labels = {r.cell_id: r.label for r in run.merged_labels().collect()}
    assert {labels[i] for i in found} == {"A_cluster0", "A_cluster1"} and {v for i, v in labels.items() if i % 3 == 0} == {"B"}
    assert {(int(r.cell_id), r.group) for r in spark.read.csv(str(tmp_path / "Cell_clusters"), header=True).collect()} == set(labels.items())
    assert [r.feature for r in run.morphology_analysis(shapes, 0.001).collect()] == ["area"]
    assert run.kde_points(most=20).select("cell_id").distinct().count() == 20
    shares = run.neighborhood_analysis(5).collect()
    assert {r["sub"] for r in shares} == set(found.values()) and all(0 < r.mean_p <= 1 for r in shares)


def test_multiscale_files(spark, tmp_path):
    from mosaicell.plans.multiscale import MultiscaleAnalysis
    from mosaicell.sources import tables

    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(4 * (i % 2), 1)), float(rng.normal()), [float(rng.normal(2 * (i % 2), 1)) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "cell_id long, x double, y double, vec array<double>")
    run = MultiscaleAnalysis(df.select("cell_id", "x", "y"), {"X": df.select("cell_id", "vec")}, "one", str(tmp_path))
    for early in (run.identify_typical_scales, run.clustering, run.simpson_by_scale, lambda: run.multiscale_transform("none"), lambda: run.cluster_points(1.0)):
        with pytest.raises(ValueError):
            early()
    simpson = run.perform_multiscale_pipeline("X", 30, 6, [0.5, 1.0, 2.0, 4.0, 8.0], [1.0], 4, 2).collect()
    assert {r.title for r in simpson} >= {"Raw"}
    assert spark.read.parquet(str(tmp_path / "one_transformed_signals")).filter("scale_idx = 2").count() == 90
    scales_csv = tables.read_csv(spark, str(tmp_path / "one_typical_scales"), "Index int, Scale double").collect()
    assert {(r.Index, r.Scale) for r in scales_csv} == {(r.idx, r.scale) for r in run.typical_scales.collect()}
    assert {r.title for r in spark.read.parquet(str(tmp_path / "one_object_kmeans")).select("title").distinct().collect()} == {r.title for r in simpson}
    drawn = run.cluster_points(1.0)
    assert drawn.count() == 90 and {"x", "y", "u1", "u2", "label"} <= set(drawn.columns)
    names = run.write(str(tmp_path / "all"))
    back = tables.read_tables(spark, str(tmp_path / "all"), names)
    assert back["labels"].count() == run.labels.count() and {"points", "rep_X", "simpson", "signals"} <= set(names)


def test_mapping_files(spark, tmp_path):
    from mosaicell.sources import tables

    rng = np.random.default_rng(7)
    p = points_of(spark, rng.uniform(0, 6, (160, 2)))
    edges = graph.symmetrize(graph.weigh(neighbors.knn(p, 6), k=6))
    out = mapping.map_scales_to_distance(p, edges, [1.5], 1.0, sample_r=1.5, target_total=20, first_round_n=8, scales=[0.0, 1.0, 3.0], radius=3.0, x_max=2.0, width=0.5, path=str(tmp_path))
    rounds = tables.read_csv(spark, str(tmp_path / "rounds"), "round int, cell_id long")
    assert sorted(map(tuple, rounds.collect())) == sorted((r["round"], r.cell_id) for r in out["rounds"].collect()) and rounds.count() >= 20
    first = tables.read_profiles(spark, str(tmp_path), [1])
    assert first.count() == out["profiles"].filter("round = 1").count() and "PartitionFilters: [isnotnull(round" in first._jdf.queryExecution().toString()
    assert spark.read.csv(str(tmp_path / "manifest"), header=True).count() == rounds.count()
    wide = spark.read.csv(str(tmp_path / "H_matrix"), header=True, inferSchema=True)
    assert sorted(c for c in wide.columns if c.startswith("dist_")) == ["dist_0.25", "dist_0.75", "dist_1.25", "dist_1.75"]
    long = {(r.grp, r.scale, r.bin): r.value for r in out["heatmap"].collect()}
    h, e = tables.read_heatmap(spark, str(tmp_path))
    assert {(r.grp, r.scale, r.bin): r.value for r in h.collect()} == long
    assert {(r.grp, r.scale, r.distance) for r in e.collect()} == {(r.grp, r.scale, r.distance) for r in out["energy"].collect()}
    only, _ = tables.read_heatmap(spark, str(tmp_path), ["All"])
    assert {r.grp for r in only.collect()} == {"All"}
    for r in wide.collect():
        for k, c in enumerate(["dist_0.25", "dist_0.75", "dist_1.25", "dist_1.75"]):
            assert abs((r[c] or 0) - (long[r.grp, float(r.scale), k] or 0)) < 1e-12
    assert {r.grp for r in spark.read.csv(str(tmp_path / "E95_distance"), header=True).collect()} >= {"All"}


def test_reduce_dimensions_by_corrected_nmf(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"g{g}", float(rng.poisson(3 + 2 * (i % 2) * (g < 3) + (i % 3)))) for i in range(60) for g in range(6)]
    expr = preprocess.preprocess(spark.createDataFrame([r for r in rows if r[2]], "cell_id long, gene string, value double"))
    batches = spark.createDataFrame([(i, f"b{i % 3}") for i in range(60)], "cell_id long, batch string")
    scores, load = factorize.reduce_dimensions(expr, "NMF_harmony", 2, batches)
    vecs = [r.vec for r in scores.collect()]
    assert len(vecs) == 60 and all(len(v) == 2 and min(v) >= 0 for v in vecs) and load.count() == 6
    for kind, b in (("PCA", batches), ("NMF", None)):
        assert factorize.reduce_dimensions(expr, kind, 2, b)[0].count() == 60
    for wrong in (lambda: factorize.reduce_dimensions(expr, "NMF_harmony", 2), lambda: factorize.reduce_dimensions(expr, "UMAP", 2)):
        with pytest.raises(ValueError):
            wrong()


def test_benchmark_writes_labels_seconds_and_memory(spark, tmp_path):
    from mosaicell.plans import benchmark

    rng = np.random.default_rng(15)
    p = points_of(spark, rng.random((80, 2)))
    rep = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(80)], "cell_id long, vec array<double>")
    table = benchmark.run_resolutions(p, rep, [1.0], str(tmp_path), n_metacells=20, n_neighbors=5, scales=[0.5, 1.0, 2.0, 4.0], max_clusters=3, min_clusters=2)
    row = table.first()
    assert row.resolution == 1.0 and row.seconds > 0 and row.peak_mb > 10 and row.labels >= 2
    labels = spark.read.option("header", True).csv(f"{tmp_path}/labels_res1.0")
    assert labels.count() == 80 and "Raw" in labels.columns and all(r.Raw.startswith("C") for r in labels.collect())
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").count() == 1


def test_package_is_shipped_from_another_folder(tmp_path):
    """A driver that finds the package by its own path alone: workers get it by ship()."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from mosaicell.operators.neighbors import knn
from mosaicell.plans.ship import ship
ship(spark)
points = spark.range(40).selectExpr("id AS cell_id", "id * 1.0D AS x", "0.0D AS y")
print("neighbours", knn(points, 2, few=0).count())
spark.stop()
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "neighbours 80" in done.stdout, done.stderr[-2000:]


def test_profiles_are_stored_by_blocks(spark, tmp_path, monkeypatch):
    """Nulls, NaN, several rounds, blocks and parts: few rows are stored, and those of pairs are read."""
    from mosaicell import queries
    from mosaicell.sources import tables

    rng = np.random.default_rng(6)
    xy = np.round(rng.uniform(0, 4, (150, 2)), 1).tolist()
    xy[149] = [float("nan"), 1.0]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double")
    rounds = spark.createDataFrame([(i, 1 + i % 2) for i in range(0, 150, 3)], "cell_id long, round int")
    value = lambda: [None, float("nan"), 0.5][rng.integers(3)] if rng.random() < 0.2 else float(rng.normal())
    signals = spark.createDataFrame([(i, s, float(s), [value(), value()]) for i in range(148) for s in range(3) if (i + s) % 10], "cell_id long, scale_idx int, scale double, vec array<double>")
    pairs = sorted(str(tuple(r)) for r in mapping.seed_profiles(points, rounds, signals, 1.3).collect())
    for at, (ask, feed, seeds) in enumerate(((1 << 14, 1 << 16, 4096), (30, 60, 10))):
        monkeypatch.setattr(neighbors, "ASK_BLOCK", ask)
        monkeypatch.setattr(neighbors, "FEED", feed)
        monkeypatch.setattr(mapping, "BLOCK_SEEDS", seeds)
        where = str(tmp_path / str(at))
        tables.write_profile_blocks(mapping.profile_blocks(points, rounds, signals, 1.3), where)
        stored = spark.read.parquet(f"{where}/seed_profiles")
        assert at or stored.count() < len(pairs) / 10
        assert sorted(str(tuple(r)) for r in tables.read_profiles(spark, where, radius=1.3).collect()) == pairs
        assert "PartitionFilters: [isnotnull(round" in tables.read_profiles(spark, where, [1], 1.3)._jdf.queryExecution().toString()
    monkeypatch.undo()
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("profiles-query-*"))
    d = "/root/testdata/sf0.001"
    assert queries.QUERIES["seed_profiles_scan"](spark, d).count() == queries.profiles(spark, d).filter("scale = 1").count()
    (made,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("profiles-query-*")) - before
    assert spark.read.parquet(f"{made}/seed_profiles").count() < 500  # of 500 points: not a row a pair


def test_binned_profiles_equal_those_of_pairs(spark, monkeypatch):
    """Ties, nulls, NaN, several rounds, blocks and parts: the same as cleaning and interpolating the table of pairs."""
    rng = np.random.default_rng(4)
    xy = np.round(rng.uniform(0, 4, (150, 2)), 1)
    odd = [None, float("nan"), 0.02, 0.5]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double")
    rounds = spark.createDataFrame([(i, 1 + i % 2) for i in range(0, 150, 3)], "cell_id long, round int")
    value = lambda: odd[rng.integers(4)] if rng.random() < 0.2 else float(rng.normal())
    signals = spark.createDataFrame([(i, s, float(s), [value(), value()]) for i in range(148) for s in range(3) if (i + s) % 10], "cell_id long, scale_idx int, scale double, vec array<double>")
    monkeypatch.setattr(neighbors, "ASK_BLOCK", 7)
    monkeypatch.setattr(neighbors, "FEED", 11)
    monkeypatch.setattr(mapping, "SLAB", 30)
    pairs = mapping.seed_profiles(points, rounds, signals, 1.3).persist()
    monkeypatch.setattr(mapping, "CARRIED", 0)
    joined = mapping.seed_profiles(points, rounds, signals, 1.3)
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(pairs) == rows(joined)
    for cut, by_self in ((0.0, False), (0.3, False), (0.0, True), (0.3, True)):
        b = mapping.binned_profiles(points, rounds, signals, 1.3, 1.0, 0.25, cut, by_self)
        clean = mapping.clean_profiles(pairs, 1.0, cut, by_self)
        assert rows(mapping.binned_counts(b)) == rows(mapping.distance_bins(clean, 1.0, 0.25))
        got = {tuple(r)[:3]: r.value for r in mapping.binned_values(b).collect()}
        want = {tuple(r)[:3]: r.value for r in mapping.interpolate(clean, 1.0, 0.25).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)
        for weight in (True, False) if cut and by_self else ():
            one, two = (mapping.heatmap(x, 1.0, 0.25, cut, by_self, counts_weight=weight, sigma=0.7) for x in (b, pairs))
            for g, w in zip(one, two, strict=True):
                g, w = ({tuple(r)[:-1]: r[-1] for r in t.collect()} for t in (g, w))
                assert g.keys() == w.keys() and all(g[k] == w[k] or np.isclose(g[k], w[k]) for k in w)
    rows_of = lambda p: rows(mapping.manifest(p, points, [], 1.3).select("seed_id", "round", "n_neighbors"))
    assert rows_of(b) == rows_of(pairs)


def test_heatmap_of_all_points_writes_no_pairs(spark, tmp_path):
    """800 points within reach of each other are 640,000 pairs at three scales; what is written stays by the point."""
    import __spark_entry__

    rng = np.random.default_rng(1)
    table = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(rng.uniform(0, 0.1, (800, 8)))]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet"))
    before = size()
    assert __spark_entry__.queries()["heatmap_counts"](spark, str(tmp_path)).count() == 15
    assert size() - before < 1000 * 800


def test_kth_distances_equal_all_pairs(spark):
    """Ties, a crowd, points of one place and a far one; k of nearly all points."""
    rng = np.random.default_rng(3)
    xy = np.round(np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(5, 0.1, (200, 2)), np.ones((60, 2)), [[50.0, 3.0]]]), 2)
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell_id long, x double, y double")
    away = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), 1)
    for k in (1, 50, 560):
        got = {r.cell_id: r.dist for r in neighbors.kth_distances(p, k).collect()}
        assert len(got) == len(xy) and np.allclose([got[i] for i in range(len(xy))], away[:, k], rtol=1e-12)
    assert neighbors.kth_distances(p, 561).count() == 0
    for cutoff, top in ((0.1, 3.0), (1 / 3, 7.7), (0.30000000000000004, 1.1)):
        r = subcluster._largest_within(cutoff, top)
        assert r / top < cutoff <= np.nextafter(r, 9.0) / top


def test_components_send_no_labels_through_the_driver(spark, monkeypatch):
    """Small enough to be broadcast, labels and edges are still joined by shuffles."""
    plans = []
    monkeypatch.setattr(graph, "save", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or storage.save(df, name))
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (7, 8, 1.0), (8, 7, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "cell_id long")
    assert {tuple(r) for r in graph.components(e, nodes).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)
    assert graph.check(e, nodes) == {"connected": False, "symmetric": True, "min_weight": 1.0}


def test_vectors_without_clusters_go_once_to_a_group_of_balls(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "GROUP_POINTS", 150)
    asked, met = [], neighbors._met_groups
    monkeypatch.setattr(neighbors, "_met_groups", lambda *a: (asked.append(sum(a[4].values())), met(*a))[1])
    v = np.random.default_rng(8).normal(size=(900, 24))
    v[500:560] = v[499]
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell_id long, vec array<double>")
    report = {}
    assert {(r.src, r.dst, r["rank"]) for r in neighbors.knn_vectors(p, 5, 0, report).collect()} == nearest_of(v, 5)
    assert report["visits"] > 900 * 16 and asked[0] <= 900 * max(neighbors.GROUPS, 6)


def test_harmony_by_small_blocks_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    scores = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 4)))], "cell_id long, vec array<double>")
    batches = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(120)], "cell_id long, batch string")
    got = lambda: np.array([r.vec for r in factorize.harmony(scores, batches, max_iter=2).orderBy("cell_id").collect()])
    whole = got()
    monkeypatch.setattr(factorize, "HELD", 20)
    assert np.allclose(got(), whole, atol=1e-9)


def test_pca_reads_its_counts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(len(b))
            yield b

    expr = spark.range(60).selectExpr("id % 20 AS cell_id", "concat('g', cast(id % 7 AS string)) AS gene", "CAST(id % 5 + 1 AS double) AS value")
    factorize.pca(expr.mapInPandas(run, expr.schema), 2)
    assert read.value == 60


def test_kth_distances_of_vectors_leave_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(subcluster, "BLOCK", 90)
    v = np.concatenate([np.random.default_rng(2).normal(size=(400, 9)), np.zeros((60, 9)), np.ones((40, 9))])
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for k in (5, 50):
        got = {r.id: r.d for r in subcluster._kth_of_vectors(p, 500, k, float(d.max() * (1 + 1e-12))).collect()}
        assert np.allclose([got[i] for i in range(500)], np.sort(d, 1)[:, k], rtol=1e-12, atol=0)


def test_local_heat_filter_returns_a_row_a_cell_and_signal(spark):
    e = spark.createDataFrame([(i, (i + j) % 30, 1.0) for i in range(30) for j in (1, 29)], "src long, dst long, weight double")
    x = spark.createDataFrame([(i, [float(i % 4), float(i == 7)]) for i in range(31)], "cell_id long, vec array<double>")
    out = spectral.heat_filter(e, x, [0.0, 0.5, 4.0], lmax=4.0, path="local")
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    got = {(r.cell_id, r.scale_idx): r.vec for r in out.collect()}
    lap = 2 * np.eye(30) - np.eye(30)[:, np.arange(1, 31) % 30] - np.eye(30)[:, np.arange(-1, 29) % 30]
    signal = np.array([[i % 4, i == 7] for i in range(30)], float)
    assert len(got) == 93 and all(got[i, 0] == signal[i].tolist() for i in range(30)) and got[30, 2] == [2.0, 0.0]
    kernel = spectral.heat_coefficients(4.0, 30)
    t, s = [np.eye(30), lap / 2 - np.eye(30)], lap / 2 - np.eye(30)
    for _ in range(2, 31):
        t.append(2 * s @ t[-1] - t[-2])
    assert np.allclose([got[i, 2] for i in range(30)], sum(c * x for c, x in zip(kernel, t, strict=True)) @ signal)


def test_seeds_look_at_few_pairs(monkeypatch):
    """Of 2,000 seeds and 2,000 cells, only pairs near a bin's centre are compared; results are those of all pairs."""
    import pyarrow as pa

    rng, n = np.random.default_rng(2), 2000
    xy, looked, nearest = rng.random((n, 2)), [], mapping._nearest_to_centers
    monkeypatch.setattr(mapping, "_nearest_to_centers", lambda d, y, centers, *a: (looked.append(d.size * len(centers)), nearest(d, y, centers, *a))[1])
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(v))
    table = pa.table({"cell_id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]})
    seeds = table.append_column("round", pa.array(np.ones(n, int))).append_column("own", lists(np.ones(n)))
    out = mapping._binned(0.3, 0.25, 0.05, 1, 1, 0.0, pa.int64())(seeds, table.append_column("flat", lists(rng.random(n)))).sort_by("seed_id")
    assert 2 * sum(looked) < 5 * n * n
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    assert out["n_neighbors"].to_pylist() == (d <= 0.3).sum(1).tolist()
    centers = (np.arange(5) + 0.5) * 0.05
    below = np.stack([np.where(d <= c, d, -np.inf).max(1) for c in centers], 1)
    above = np.stack([np.where((d > c) & (d <= 0.25), d, np.inf).min(1) for c in centers], 1)
    assert np.array_equal(np.stack(out["lo_d"].to_pylist()), below) and np.array_equal(np.stack(out["hi_d"].to_pylist()), above)
    assert np.array_equal(np.stack(out["counts"].to_pylist()), np.stack([((d / 0.05 >= b) & (d / 0.05 < b + 1) & (d <= 0.25)).sum(1) for b in range(5)], 1))


@pytest.mark.parametrize("path", ["tiles", "joins"])
def test_exchanged_terms_leave_the_disk(spark, monkeypatch, path):
    """Of an order of 20, what stays on disk is the last exchange's block, not 20 terms."""
    rng = np.random.default_rng(21)
    p = points_of(spark, rng.random((600, 2)))
    edges = spark.createDataFrame(graph.symmetrize(graph.weigh(neighbors.knn(p, 4), k=4)).collect())
    signals = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(602)], "cell_id long, vec array<double>")
    monkeypatch.setattr(spectral, "TILE_CELLS", 100)
    want = {(r.cell_id, r.scale_idx): r.vec for r in spectral.heat_filter(edges, signals, [0.0, 2.0], 20, "bound", "local").collect()}
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet"))
    before = size()
    got = spectral.heat_filter(edges, signals, [0.0, 2.0], 20, "bound", path, p)
    assert size() - before < 602 * 8 * 8 * 6
    rows = got.collect()
    assert len(rows) == 1204 and all(np.allclose(r.vec, want[r.cell_id, r.scale_idx], atol=1e-12) for r in rows)
    for scales in ([1.0], [0.0, *(float(s) for s in range(1, 8))]):  # without places, by hashed parts; many scales keep their terms
        monkeypatch.setattr(spectral, "PART_CELLS", 100)
        want = {(r.cell_id, r.scale_idx): r.vec for r in spectral.heat_filter(edges, signals, scales, 7, "bound", "local").collect()}
        rows = spectral.heat_filter(edges, signals, scales, 7, "bound", path, p if path == "tiles" else None).collect()
        assert len(rows) == 602 * len(scales) and all(np.allclose(r.vec, want[r.cell_id, r.scale_idx], atol=1e-12) for r in rows)


def test_near_profiles_equal_cleaned_ones_without_a_join_of_pairs(spark, monkeypatch):
    """Nulls, NaN, two rounds, blocks and parts; the seed's own value comes along with it."""
    from mosaicell import queries

    rng = np.random.default_rng(8)
    xy = np.round(rng.uniform(0, 4, (150, 2)), 1).tolist()
    xy[149] = [float("nan"), 1.0]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double")
    rounds = spark.createDataFrame([(i, 1 + i % 2) for i in range(0, 150, 3)], "cell_id long, round int")
    value = lambda: [None, float("nan"), 0.5][rng.integers(3)] if rng.random() < 0.2 else float(rng.normal())
    signals = spark.createDataFrame([(i, s, float(s), [value(), value()]) for i in range(148) for s in range(3) if (i + s) % 10], "cell_id long, scale_idx int, scale double, vec array<double>")
    monkeypatch.setattr(mapping, "CARRIED", 0)
    pairs = mapping.seed_profiles(points, rounds, signals, 1.3).persist()
    rows = lambda df: sorted(str(tuple(r)) for r in df.select("seed_id", "round", "nbr_id", "distance", "scale", "intensity").collect())
    for ask, feed, some in ((16_384, 8192, 1 << 18), (30, 20, 640)):
        monkeypatch.setattr(neighbors, "ASK_BLOCK", ask)
        monkeypatch.setattr(neighbors, "ROWS_FEED", feed)
        monkeypatch.setattr(neighbors, "PAIRS", some)
        for cut, by_self in ((0.0, False), (0.3, False), (0.0, True), (0.3, True)):
            got = mapping.near_profiles(points, rounds, signals, 1.0, cut, by_self)
            assert rows(got) == rows(mapping.clean_profiles(pairs, 1.0, cut, by_self))
    good = pairs.filter("nbr_id = seed_id AND intensity > 0.1").select("seed_id", "scale")
    want = mapping.clean_profiles(pairs, 1.0, by_self=True).join(good, ["seed_id", "scale"], "left_semi")
    assert rows(mapping.near_profiles(points, rounds, signals, 1.0, by_self=True, least=0.1)) == rows(want)
    monkeypatch.undo()
    for name in ("intensity_cut", "profiles_by_self", "radius_join", "seed_profiles_scan"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above = plan.split("InArrow")[0]
        assert "InArrow" in plan and "Join" not in above and "round(" not in above
        assert name != "seed_profiles_scan" or "Generate" not in plan


def test_rounding_in_tasks_equals_that_of_spark(spark):
    from mosaicell.functions.numeric import rounded

    rng = np.random.default_rng(3)
    half = (rng.integers(-(10**6), 10**6, 500) + 0.5) / 1e6
    x = np.concatenate([half, np.nextafter(half, 9), np.nextafter(half, -9), rng.normal(size=500), rng.normal(size=50) * 1e12, [0.0, -1e-9, float("nan"), float("inf"), -float("inf"), 1e300]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    for digits in (6, 3):
        want = [r.r for r in df.select("i", F.round("v", digits).alias("r")).orderBy("i").collect()]
        assert all(a == b or (np.isnan(a) and np.isnan(b)) for a, b in zip(rounded(x, digits).tolist(), want, strict=True))


def test_nearest_higher_points_leave_no_pairs(spark, monkeypatch):
    """Rectangles, blocks of either side and points of one place: the same as all pairs, and no plan joins pairs or explodes rings."""
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.normal(0, 1, (300, 2)), np.tile([[0.5, 0.5]], (40, 1)), [[50.0, 0.0]]])
    rank = rng.permutation(len(xy)).astype(float)
    rho = spark.createDataFrame([(i, float(x), float(y), float(r)) for i, ((x, y), r) in enumerate(zip(xy, rank, strict=True))], "cell_id long, x double, y double, rho double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    up = np.where(rank[None] > rank[:, None], d, np.inf)
    want = {i: (up[i].min(), up[i].argmin()) for i in range(len(xy)) if up[i].min() < np.inf}
    for part, asking, targets, slab in ((1024, 2048, 4096, 1 << 17), (20, 7, 9, 30)):
        for name, value in (("PART", part), ("ASKING", asking), ("TARGETS", targets), ("SLAB", slab)):
            monkeypatch.setattr(subcluster, name, value)
        found = subcluster._uphill_in_plane(rho, len(xy))
        assert {r.cell_id: (r.d, r.parent) for r in found.collect()} == want
        assert "gx" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("local", [10**6, 5, 0])
def test_components_contract_until_a_task_unites_the_rest(spark, monkeypatch, local):
    """Chains against the order of ids, stars, loops and lone nodes, each round with fewer edges."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = np.random.default_rng(2)
    order = rng.permutation(60).tolist()
    pairs = list(zip(order[:39], order[1:40], strict=True)) + [(200 - i, 201 - i) for i in range(50)] + [(300, i) for i in range(301, 310)] + [(5000, 5000)]
    e = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")
    root = {i: i for p in pairs for i in p}
    for _ in pairs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    saved = []
    monkeypatch.setattr(graph, "save", lambda df, name: saved.append(name) or storage.save(df, name))
    assert {r.cell_id: r.component for r in graph.components(e).collect()} == root
    assert len(saved) == 3 if local == 10**6 else len(saved) > 3
    nodes = spark.createDataFrame([(i,) for i in (*root, 9999)], "cell_id long")
    assert {r.cell_id: r.component for r in graph.components(e, nodes).collect()} == root | {9999: 9999}
    named = e.select(F.format_string("n%05d", "src").alias("src"), F.format_string("n%05d", "dst").alias("dst"))
    assert {r.cell_id: r.component for r in graph.components(named).collect()} == {f"n{a:05d}": f"n{b:05d}" for a, b in root.items()}


def test_vectors_are_compared_exactly_only_where_a_product_leaves_doubt(monkeypatch):
    """Far from the origin, with equal vectors: the counts, bins and nearest of all pairs, of which few are taken term by term."""
    import pandas as pd

    rng = np.random.default_rng(14)
    v = np.round(np.concatenate([rng.normal(0, 1, (380, 20)), np.zeros((20, 20))]) + 1000, 3)
    n = len(v)
    d = np.zeros((n, n))
    for k in range(20):
        d += (v[:, k, None] - v[None, :, k]) ** 2
    d = np.sqrt(d)
    top, rho = d.max(), rng.permutation(n).astype(float)
    side = pd.DataFrame({"id": range(n), "vec": list(v), "rho": rho, "lo": 0.0, "hi": np.nextafter(top, 9e9)})
    both = pd.concat([side.assign(asks=True), side.assign(asks=False).sample(frac=1, random_state=1)])
    taken = []
    exact = subcluster._Pairs.exact
    monkeypatch.setattr(subcluster._Pairs, "exact", lambda self, i, j: taken.append(len(i)) or exact(self, i, j))
    assert subcluster._top(both)["top"][0] == top
    cutoff = np.sort(d[3])[40] / top  # one of the distances
    assert subcluster._within(cutoff, top)(both)["k"].tolist() == (d / top < cutoff).sum(1).tolist()
    edges = subcluster._edges(side["lo"].to_numpy(), side["hi"].to_numpy())[0]
    assert np.array_equal(np.stack(subcluster._binned(both)["bins"]), np.stack([np.histogram(x, edges)[0] for x in d]))
    up = np.where(rho[None] > rho[:, None], d, np.inf)
    got = subcluster._uphill(both)
    assert np.array_equal(got["d"], up.min(1)) and np.array_equal(got["far"], d.max(1))
    assert all(up[i].min() == np.inf or got["up"][i] == up[i].argmin() for i in range(n))
    assert sum(taken) < n * n / 10
