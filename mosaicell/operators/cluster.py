"""Two-step clustering: k-means metacells of all cells, then communities of the metacells.

The first step is distributed; the second sees at most n_metacells rows a title, so each title
and resolution is one task, and all titles run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.communities import fuzzy_graph, leiden, umap_layout
from ..plans.storage import save
from .kmeans import BATCH, complete, minibatch_kmeans, nearest_center
from .preprocess import standardize

NEIGHBORS = 15


def metacells(cells: DataFrame, k: int | None = None, scale: bool = True, seed: int = 1, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """cells(cell_id, vec) -> cells(cell_id, metacell), centers(metacell, vec), by mini-batch k-means."""
    n = cells.count()
    k = min(n, k if k is not None else max(1, n // 10))
    rows = complete(cells.select("cell_id", "vec"))
    if scale:
        rows = standardize(rows)
    rows = save(rows, "kmeans")
    spark, schema = cells.sparkSession, "metacell int, vec array<double>"
    centers = minibatch_kmeans(rows, k, seed, batch)
    if not len(centers):
        return rows.select("cell_id", F.lit(0).alias("metacell")).limit(0), spark.createDataFrame([], schema)
    found = save(nearest_center(rows, centers), "metacells")
    return found, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], schema)


def _communities(resolutions: list[float], layout: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("metacell")
        x = np.stack(rows["vec"].to_numpy()).astype(float)
        n, k = len(x), min(NEIGHBORS, len(rows) - 1)
        u = np.zeros((n, 2))
        if k < 1:
            labels = {r: np.zeros(n, int) for r in resolutions}
        else:
            idx, dist = np.zeros((n, k), int), np.zeros((n, k))
            for at in range(0, n, 512):
                part = x[at : at + 512]
                d = np.maximum(0, (part**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * part @ x.T)
                d[np.arange(len(part)), at + np.arange(len(part))] = np.inf
                near = np.argsort(d, 1, kind="stable")[:, :k]
                idx[at : at + 512], dist[at : at + 512] = near, np.sqrt(np.take_along_axis(d, near, 1))
            src, dst, w = fuzzy_graph(idx, dist)
            labels = {r: leiden(n, src, dst, w, r) for r in resolutions}
            if layout:
                u = umap_layout(x, src, dst, w)
        return pd.concat([pd.DataFrame({"title": rows["title"], "metacell": rows["metacell"], "resolution": r, "community": labels[r], "u1": u[:, 0], "u2": u[:, 1]}) for r in resolutions])

    return run


def two_step(cells: DataFrame, resolutions: list[float], k: int | None = None, scale: bool = True, title: str = "Raw", layout: bool = True, seed: int = 1) -> dict[str, DataFrame]:
    """labels(title, resolution, cell_id, label), layout(title, cell_id, u1, u2), metacells and
    centers. Labels are C0, C1, ... by size."""
    found, centers = metacells(cells, k, scale, seed)
    return _second_step(found.withColumn("title", F.lit(title)), centers.withColumn("title", F.lit(title)), resolutions, layout)


def _second_step(found: DataFrame, centers: DataFrame, resolutions: list[float], layout: bool) -> dict[str, DataFrame]:
    made = centers.groupBy("title").applyInPandas(_communities(resolutions, layout), "title string, metacell int, resolution double, community int, u1 double, u2 double")
    made = save(made, "communities")
    raw = found.join(made, ["title", "metacell"]).select("title", "resolution", "cell_id", "community")
    sizes = raw.groupBy("title", "resolution", "community").agg(F.count("*").alias("n"), F.min("cell_id").alias("first"))
    names = sizes.withColumn("label", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy("title", "resolution").orderBy(F.desc("n"), "first")) - 1))
    labels = raw.join(names.select("title", "resolution", "community", "label"), ["title", "resolution", "community"]).select("title", "resolution", "cell_id", "label")
    place = found.join(made.filter(F.col("resolution") == float(resolutions[0])).select("title", "metacell", "u1", "u2"), ["title", "metacell"]).select("title", "cell_id", "u1", "u2")
    return {"labels": labels, "layout": place, "metacells": found, "centers": centers}


def two_step_scales(signals: DataFrame, scales: list[tuple[int, float]], resolutions: list[float], k: int | None = None, scale: bool = True, layout: bool = True) -> dict[str, DataFrame]:
    """The same for picked scales of signals(cell_id, scale_idx, scale, vec); titles 'scale<s>'.
    Only the picked scales' partitions are read; all titles share the second step."""
    founds = centers = None
    for idx, s in scales:
        a, b = metacells(signals.filter(F.col("scale_idx") == idx), k, scale)
        a, b = a.withColumn("title", F.lit(f"scale{s}")), b.withColumn("title", F.lit(f"scale{s}"))
        founds, centers = (a, b) if founds is None else (founds.unionByName(a), centers.unionByName(b))
    if founds is None:
        raise ValueError("no scales given")
    return _second_step(founds, centers, resolutions, layout)
