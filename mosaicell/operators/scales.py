"""Critical scales: correlation between scales, contiguous blocks, their starts and centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import knee


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and sums of centred products of disjoint sets of rows, put together."""
    n, mean, m2 = parts[0]
    for k, other, more in parts[1:]:
        if not k:
            continue
        away = other - mean
        m2 = m2 + more + away[..., :, None] * away[..., None, :] * (n * k / max(1, n + k))
        mean, n = mean + away * (k / (n + k)), n + k
    return n, mean, m2


def _moments(scales: int):
    """Of a task's cells, for each component: the count, the scales' means and centred products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column("vecs").flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(batch), scales, -1).transpose(2, 0, 1)  # component, cell, scale
            mean = x.mean(1)
            centred = x - mean[:, None]
            part = (len(batch), mean, centred.transpose(0, 2, 1) @ centred)
            total = part if total is None else _merged([total, part])
        if total is not None:
            n, mean, m2 = total
            lists = lambda a: pa.array(a.reshape(len(a), -1).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), pa.array([n] * len(mean), pa.int64()), lists(mean), lists(m2)], ["component", "n", "mean", "m2"])

    return run


def _correlations(part: pd.DataFrame) -> pd.DataFrame:
    scales = len(part["mean"].iloc[0])
    n, _, m2 = _merged([(int(k), np.array(m), np.array(v).reshape(scales, scales)) for k, m, v in zip(part["n"], part["mean"], part["m2"], strict=True)])
    spread = np.sqrt(np.maximum(0, np.diag(m2)))
    constant = spread <= 1e-12 * np.sqrt(max(1, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = m2 / (spread[:, None] * spread[None])
    r[constant], r[:, constant] = np.nan, np.nan
    i, j = np.triu_indices(scales)
    return pd.DataFrame({"s1": i.astype(np.int32), "s2": j.astype(np.int32), "r": [None if np.isnan(x) else float(x) for x in r[i, j]]})


def scale_correlation(signals: DataFrame) -> DataFrame:
    """signals(cell_id, scale_idx, vec) -> s1, s2, corr: Pearson over cells in each component,
    averaged over components; null if a component is constant at either scale. Scales are numbered
    from 0, and cells that lack one don't count.

    One row a cell holds its values at all scales. Each task sums the products of all pairs of
    scales by matrix products, and one small matrix for each component and task is shuffled."""
    scales = (signals.agg(F.max("scale_idx")).first()[0] or 0) + 1
    cell = signals.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("scale_idx", "vec"))).alias("s")).filter(F.size("s") == scales)
    values = cell.select(F.transform("s", lambda x: x["vec"].cast("array<double>")).alias("vecs"))
    sums = values.mapInArrow(_moments(scales), "component int, n long, mean array<double>, m2 array<double>")
    each = sums.groupBy("component").applyInPandas(_correlations, "s1 int, s2 int, r double")
    means = each.groupBy("s1", "s2").agg(F.avg("r").alias("m"), F.count("r").alias("k"), F.count("*").alias("n"))
    return means.select("s1", "s2", F.when(F.col("k") == F.col("n"), F.col("m")).alias("corr"))


def correlation_matrix(corr: DataFrame) -> np.ndarray:
    rows = corr.collect()  # one row for a pair of scales
    n = max((r.s2 for r in rows), default=-1) + 1
    out = np.full((n, n), np.nan)
    for r in rows:
        out[r.s1, r.s2] = out[r.s2, r.s1] = np.nan if r["corr"] is None else r["corr"]
    return out


class BlockCosts:
    """Population variance of any diagonal block, by prefix sums."""

    def __init__(self, m: np.ndarray):
        pad = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        self.s, self.q, self.n = pad(m), pad(m * m), len(m)

    def __call__(self, i: int, j: int) -> float:
        """Rows and columns i to j, both included."""
        a, b = i, j + 1
        box = lambda p: p[b, b] - p[a, b] - p[b, a] + p[a, a]
        k = (b - a) ** 2
        mean = box(self.s) / k
        return 0.0 if k == 1 else max(0.0, box(self.q) / k - mean * mean)


def best_blocks(m: np.ndarray, k: int) -> tuple[float, list[tuple[int, int]]]:
    """The k contiguous blocks with the least sum of variances, earliest splits among equals."""
    n, cost = len(m), BlockCosts(m)
    best = np.full((k + 1, n + 1), np.inf)
    cut = np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0
    for parts in range(1, k + 1):
        for end in range(parts, n + 1):
            for start in range(parts - 1, end):
                value = best[parts - 1, start] + cost(start, end - 1)
                if value < best[parts, end] - 1e-15:
                    best[parts, end], cut[parts, end] = value, start
    blocks, end = [], n
    for parts in range(k, 0, -1):
        blocks.append((int(cut[parts, end]), end - 1))
        end = int(cut[parts, end])
    return float(best[k, n]), blocks[::-1]


def block_center(m: np.ndarray, block: tuple[int, int]) -> int:
    """The row of the block with the least summed distance to its other rows."""
    a, b = block
    sub = m[a : b + 1, a : b + 1]
    return a + int(np.sqrt(((sub[:, None] - sub[None]) ** 2).sum(-1)).sum(1).argmin())


def pick_scales(m: np.ndarray, scales: list[float], min_clusters: int = 3, max_clusters: int = 10, dedupe: bool = True):
    """-> blocks, [(index, scale)]: starts and centres of the blocks at the elbow of the total
    variance. Without an elbow min_clusters blocks are taken."""
    ks = list(range(min_clusters, min(max_clusters, len(m)) + 1))
    if not ks:
        raise ValueError("fewer scales than min_clusters")
    totals = [best_blocks(m, k)[0] for k in ks]
    k = knee(ks, totals, "convex", "decreasing", 1.0)
    blocks = best_blocks(m, int(k) if k is not None else min_clusters)[1]
    picked = sorted([a for a, _ in blocks] + [block_center(m, b) for b in blocks])
    if dedupe:
        picked = sorted(set(picked))
    return blocks, [(i, float(scales[i])) for i in picked]


def identify_scales(signals: DataFrame, scales: list[float], min_clusters: int = 3, max_clusters: int = 10, dedupe: bool = True):
    """-> correlation matrix, blocks, typical_scales(idx, scale) as a DataFrame."""
    m = correlation_matrix(scale_correlation(signals))
    blocks, picked = pick_scales(m, scales, min_clusters, max_clusters, dedupe)
    return m, blocks, signals.sparkSession.createDataFrame(picked, "idx int, scale double")
