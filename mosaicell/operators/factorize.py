"""Matrix factorisation of counts: PCA, NMF, Harmony correction.

Cells are rows of (gene index, value) arrays; what is shared is genes x components or smaller.
Passes over the cells run in Arrow batches and return partial sums of fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import save
from .preprocess import expm1, gene_stats, log1p, nonnegative, normalize_total, quantile_clip

VEC = "array<double>"


def gene_list(expr: DataFrame) -> list[str]:
    return [r[0] for r in expr.select("gene").distinct().orderBy("gene").collect()]


def rows_of(expr: DataFrame, genes: list[str]) -> DataFrame:
    """cell_id, idx, val: one row a cell."""
    index = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, i int")
    pairs = expr.join(F.broadcast(index), "gene").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("p"))
    return pairs.select("cell_id", F.transform("p", lambda x: x["i"]).alias("idx"), F.transform("p", lambda x: x["value"].cast("double")).alias("val"))


def _dense(rows: pd.DataFrame, g: int) -> np.ndarray:
    out = np.zeros((len(rows), g))
    if len(rows):
        lengths = rows["idx"].map(len).to_numpy()
        out[np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows["idx"].to_numpy()).astype(int)] = np.concatenate(rows["val"].to_numpy())
    return out


def _chunks(batches, g: int):
    """Dense blocks of a bounded number of values."""
    step = max(1, (1 << 20) // max(1, g))
    for b in batches:
        for at in range(0, len(b), step):
            yield _dense(b.iloc[at : at + step], g)


#: Values of one row of a partial sum.
PIECE = 4096


def _sum_partials(df: DataFrame, run, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """run(iterator of batches) -> arrays; each task's arrays are added up in the cluster, piece by piece."""

    def partial(batches):
        flat = np.concatenate([np.ravel(a) for a in run(batches)])
        for k in range(0, len(flat), PIECE):
            if flat[k : k + PIECE].any():
                yield pd.DataFrame({"piece": [k // PIECE], "v": [flat[k : k + PIECE]]})

    def total(key, rows):
        v = sum(x.values.to_numpy() for x in rows["v"])
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v], pa.list_(pa.float64()))})

    sums = df.mapInPandas(partial, "piece int, v array<double>").groupBy("piece").applyInArrow(total, "piece int, v array<double>").toPandas()
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes))
    for piece, v in zip(sums["piece"], sums["v"], strict=True):
        flat[piece * PIECE : piece * PIECE + len(v)] = v
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def moments(rows: DataFrame, g: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of cells, sums and sums of squares by gene."""

    def run(batches):
        n, s, q = np.zeros(1), np.zeros(g), np.zeros(g)
        for x in _chunks(batches, g):
            n += len(x)
            s += x.sum(0)
            q += (x * x).sum(0)
        return [n, s, q]

    n, s, q = _sum_partials(rows, run, [(1,), (g,), (g,)])
    return int(n[0]), s, q


#: Random directions beyond those wanted, and passes over the cells, at most.
EXTRA, PASSES = 10, 12


def principal(rows: DataFrame, g: int, d: int, mean: np.ndarray, std: np.ndarray, tolerance: float = 1e-8, report: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The d greatest eigenvalues and vectors of C'C, C = (X - mean) / std, by a block Krylov range
    finder: a pass multiplies d + EXTRA directions by C'C, so what tasks return and the driver holds
    is genes x directions, never genes x genes. It ends when the residuals of all d are small."""
    width = min(g, d + EXTRA)
    block = np.eye(g) if width == g else np.linalg.qr(np.random.default_rng(0).normal(size=(g, width)))[0]
    basis, images, done = np.zeros((g, 0)), np.zeros((g, 0)), 0
    while True:
        scaled = block / std[:, None]
        shift = mean @ scaled

        def run(batches, scaled=scaled, shift=shift):
            y, total = np.zeros((g, scaled.shape[1])), np.zeros(scaled.shape[1])
            for x in _chunks(batches, g):
                z = x @ scaled - shift
                y += x.T @ z
                total += z.sum(0)
            return [y, total]

        y, total = _sum_partials(rows, run, [(g, block.shape[1]), (block.shape[1],)])
        image = (y - np.outer(mean, total)) / std[:, None]
        basis, images, done = np.hstack([basis, block]), np.hstack([images, image]), done + 1
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values, kind="stable")[:d]
        found, w = basis @ vectors[:, top], values[top]
        away = np.linalg.norm(images @ vectors[:, top] - found * w, axis=0)
        if report is not None:
            report.update(passes=done, width=basis.shape[1])
        if away.max(initial=0) <= tolerance * max(abs(w).max(initial=0), 1e-300) or basis.shape[1] >= g or done == PASSES:
            return w, found
        # what the new images add to the basis; twice, for the sake of rounding
        fresh = image - basis @ (basis.T @ image)
        fresh -= basis @ (basis.T @ fresh)
        block, r = np.linalg.qr(fresh)
        block = block[:, np.abs(np.diag(r)) > 1e-12 * max(abs(w).max(initial=0), 1e-300)][:, : g - basis.shape[1]]
        if not block.shape[1]:
            return w, found


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def pca(expr: DataFrame, n_components: int = 50) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """scores(cell_id, vec), loadings(gene, vec), explained variances; zero-centred."""
    expr = save(expr.select("cell_id", "gene", "value"), "counts")  # read for its genes and its rows
    genes = gene_list(expr)
    g = len(genes)
    rows = save(rows_of(expr, genes), "rows")
    n, s, _ = moments(rows, g)
    mean = s / max(1, n)
    values, vectors = principal(rows, g, max(1, min(n_components, g, n - 1)), mean, np.ones(g))
    load = _signed(vectors)
    return _project(rows, load, mean @ load, g), _loadings(expr, genes, load), values / max(1, n - 1)


def _project(rows: DataFrame, load: np.ndarray, shift: np.ndarray, g: int) -> DataFrame:
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            z = _dense(b, g) @ load - shift
            yield pd.DataFrame({"cell_id": b["cell_id"], "vec": list(z)})

    return rows.mapInPandas(run, f"cell_id {kind}, vec {VEC}")


def _loadings(expr: DataFrame, genes: list[str], load: np.ndarray) -> DataFrame:
    return expr.sparkSession.createDataFrame([(g, [float(x) for x in v]) for g, v in zip(genes, load, strict=True)], f"gene string, vec {VEC}")


# ------------------------------------------------------------------ NMF


def nndsvd(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Start of H (components x genes) from the dominant signed parts of the right vectors."""
    out = []
    for k in range(len(values)):
        v = vectors[:, k] * np.sign(vectors[np.abs(vectors[:, k]).argmax(), k])
        up, down = np.maximum(v, 0), np.maximum(-v, 0)
        best = np.abs(v) if k == 0 else up if np.linalg.norm(up) >= np.linalg.norm(down) else down
        out.append(np.sqrt(max(values[k], 0) ** 0.5) * best / (np.linalg.norm(best) or 1.0))
    return np.maximum(np.array(out), 1e-6)


def _solve_w(x: np.ndarray, h: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Rows of W for fixed H by coordinate descent."""
    hh, xh = h @ h.T, x @ h.T
    w = np.maximum(0, xh / np.maximum(np.diag(hh), 1e-12)) / len(h)
    for _ in range(sweeps):
        for k in range(len(h)):
            if hh[k, k] > 0:
                w[:, k] = np.maximum(0, w[:, k] + (xh[:, k] - w @ hh[:, k]) / hh[k, k])
    return w


def nmf(expr: DataFrame, n_components: int = 50, max_iter: int = 30, tol: float = 1e-4) -> tuple[DataFrame, DataFrame, list[float]]:
    """scores(cell_id, vec) and loadings(gene, vec), both non-negative, and the losses.

    W follows from H row by row, so only H is kept; an iteration is one pass that returns W'X,
    W'W and the loss."""
    expr = save(expr.select("cell_id", "gene", "value"), "counts")  # read for its genes and its rows
    genes = gene_list(expr)
    g = len(genes)
    rows = save(rows_of(expr, genes), "rows")
    n, _, squares = moments(rows, g)
    d = max(1, min(n_components, g, max(1, n)))
    # a start needs no more than a rough range
    h, total, losses = nndsvd(*principal(rows, g, d, np.zeros(g), np.ones(g), 1e-4)), float(squares.sum()), []
    for _ in range(max_iter):

        def run(batches, h=h):
            wx, ww, fit = np.zeros((d, g)), np.zeros((d, d)), np.zeros(1)
            for x in _chunks(batches, g):
                w = _solve_w(x, h)
                wx += w.T @ x
                ww += w.T @ w
                fit += ((x - w @ h) ** 2).sum()
            return [wx, ww, fit]

        wx, ww, fit = _sum_partials(rows, run, [(d, g), (d, d), (1,)])
        losses.append(float(fit[0]))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tol * max(losses[0], 1e-12) or total == 0:
            break
        for _ in range(5):
            for k in range(d):
                if ww[k, k] > 0:
                    h[k] = np.maximum(0, h[k] + (wx[k] - ww[k] @ h) / ww[k, k])
    kind = rows.schema["cell_id"].dataType.simpleString()

    def scores(batches):
        for b in batches:
            yield pd.DataFrame({"cell_id": b["cell_id"], "vec": list(_solve_w(_dense(b, g), h))})

    return rows.mapInPandas(scores, f"cell_id {kind}, vec {VEC}"), _loadings(expr, genes, h.T), losses


# ------------------------------------------------------------------ Harmony

#: Shares of cells in clusters that a task holds at a time.
HELD = 1 << 17


def harmony(scores: DataFrame, batches: DataFrame, theta: float = 1.0, max_iter: int = 20, sigma: float = 0.1, n_clusters: int | None = None, ridge: float = 1.0, seed: int = 0, tol: float = 1e-3) -> DataFrame:
    """scores(cell_id, vec), batches(cell_id, batch) -> cell_id, vec with batch effects removed:
    soft k-means on the unit sphere that favours mixed clusters, and a ridge fit of the batches
    in each cluster. Passes return sums by cluster and batch only."""
    names = [r[0] for r in batches.select("batch").distinct().orderBy("batch").collect()]
    index = scores.sparkSession.createDataFrame([(b, i) for i, b in enumerate(names)], "batch string, b int")
    data = save(scores.join(batches.select("cell_id", F.col("batch").cast("string").alias("batch")), "cell_id").join(F.broadcast(index), "batch").select("cell_id", "vec", "b"), "harmony")
    n, nb = data.count(), len(names)
    if not n:
        return scores
    d = data.select(F.size("vec")).first()[0]
    k = n_clusters or max(1, min(100, n // 30))
    share = np.zeros(nb)
    for r in data.groupBy("b").agg(F.count("*").alias("n")).collect():
        share[r.b] = r.n / n
    start = data.orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").limit(k).select("vec").toPandas()
    centers = np.stack(start["vec"].to_numpy())
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    k = len(centers)
    observed = np.outer(np.full(k, n / k), share)
    shifts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (centers, penalty, beta) of each correction
    kind = data.schema["cell_id"].dataType.simpleString()

    def soft(z, b, centers, penalty):
        unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        logits = -2 * (1 - unit @ centers.T) / sigma + penalty[:, b].T
        r = np.exp(logits - logits.max(1, keepdims=True))
        return unit, r / r.sum(1, keepdims=True)

    def corrected(z, b, steps):
        x = z
        for c, p, beta in steps:
            _, r = soft(x, b, c, p)
            x = z.copy()
            for j in np.unique(b):
                x[b == j] -= r[b == j] @ beta[:, j]
        return x

    step = max(1, HELD // k)

    def blocks(it):
        """Of each batch, a bounded number of shares by cluster at a time."""
        for part in it:
            for at in range(0, len(part), step):
                own = part.iloc[at : at + step]
                yield own, np.stack(own["vec"].to_numpy()), own["b"].to_numpy(int)

    def sums(steps, centers, penalty):
        def run(it):
            o, yc, rz = np.zeros((k, nb)), np.zeros((k, d)), np.zeros((k, nb, d))
            for _, z, b in blocks(it):
                unit, r = soft(corrected(z, b, steps), b, centers, penalty)
                yc += r.T @ unit
                for j in range(nb):
                    m = b == j
                    o[:, j] += r[m].sum(0)
                    rz[:, j] += r[m].T @ z[m]
            return [o, yc, rz]

        return _sum_partials(data, run, [(k, nb), (k, d), (k, nb, d)])

    for _ in range(max_iter):
        before = centers
        for _ in range(3):
            expected = observed.sum(1, keepdims=True) * share
            penalty = theta * np.log((expected + 1) / (observed + 1))
            observed, yc, rz = sums(shifts, centers, penalty)
            centers = yc / np.maximum(np.linalg.norm(yc, axis=1, keepdims=True), 1e-12)
        expected = observed.sum(1, keepdims=True) * share
        penalty = theta * np.log((expected + 1) / (observed + 1))
        observed, yc, rz = sums(shifts, centers, penalty)
        beta = np.zeros((k, nb, d))
        for c in range(k):
            # intercept and batches; the intercept isn't penalised
            a = np.zeros((nb + 1, nb + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = observed[c].sum(), observed[c], observed[c]
            a[1:, 1:] = np.diag(observed[c] + ridge)
            right = np.vstack([rz[c].sum(0), rz[c]])
            beta[c] = np.linalg.lstsq(a, right, rcond=None)[0][1:]
        shifts = [*shifts, (centers, penalty, beta)]
        if np.abs(centers - before).max() < tol:
            break

    def final(it):
        for part, z, b in blocks(it):
            yield pd.DataFrame({"cell_id": part["cell_id"], "vec": list(corrected(z, b, shifts))})

    return data.mapInPandas(final, f"cell_id {kind}, vec {VEC}")


def harmony_correct_counts(expr: DataFrame, batches: DataFrame, target: float = 1e4, quantile: float = 0.9999, theta: float = 1.0, max_iter: int = 20, strategy: str = "shift", n_pcs: int = 50, seed: int = 0) -> DataFrame:
    """Counts with batch effects removed: normalise, clip, log, scale, PCA, Harmony and all the way
    back. The result is dense by nature: a row for each cell and gene."""
    if strategy not in ("shift", "clip"):
        raise ValueError("strategy must be 'shift' or 'clip'")
    logged = save(log1p(quantile_clip(normalize_total(expr, target).select("cell_id", "gene", "value"), quantile)), "logged")
    genes = gene_list(logged)
    g = len(genes)
    stats = {r.gene: (r["mean"], r["std"]) for r in gene_stats(logged).collect()}
    mean = np.array([stats[x][0] for x in genes])
    std = np.array([stats[x][1] or 1.0 for x in genes])
    rows = save(rows_of(logged, genes), "rows")
    n = rows.count()
    load = _signed(principal(rows, g, max(1, min(n_pcs, min(n, g) - 1)), mean, std)[1])
    scores = _project(rows, load / std[:, None], (mean / std) @ load, g)
    fixed = harmony(scores, batches, theta, max_iter, seed=seed)
    kind = rows.schema["cell_id"].dataType.simpleString()

    def back(it):
        for part in it:
            x = np.stack(part["vec"].to_numpy()) @ load.T * std + mean
            yield pd.DataFrame({"cell_id": np.repeat(part["cell_id"].to_numpy(), g), "gene": np.tile(np.array(genes, object), len(part)), "value": x.ravel()})

    return nonnegative(expm1(fixed.mapInPandas(back, f"cell_id {kind}, gene string, value double")), strategy)


def reduce_dimensions(expr: DataFrame, kind: str = "NMF", n_components: int = 50, batches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """scores(cell_id, vec), loadings(gene, vec). kind: 'NMF', 'PCA' (corrected by Harmony if
    batches are given) or 'NMF_harmony' (of corrected counts; expr needs a column `counts`)."""
    if kind == "NMF":
        return nmf(expr, n_components)[:2]
    if kind == "PCA":
        scores, load, _ = pca(expr, n_components)
        return (scores if batches is None else harmony(scores, batches)), load
    if kind == "NMF_harmony":
        if batches is None:
            raise ValueError("NMF_harmony needs batches")
        counts = expr.withColumn("value", F.col("counts")) if "counts" in expr.columns else expr
        fixed = save(harmony_correct_counts(counts.select("cell_id", "gene", "value"), batches), "corrected")
        return nmf(log1p(normalize_total(fixed)), n_components)[:2]
    raise ValueError("kind must be 'NMF', 'PCA' or 'NMF_harmony'")
