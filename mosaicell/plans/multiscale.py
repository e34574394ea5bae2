"""The multi-scale pipeline: graph, filter bank, critical scales, clusters, Simpson indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import two_step, two_step_scales
from ..operators.composition import mean_simpson, simpson_indices
from ..operators.graph import symmetrize, weigh
from ..operators.neighbors import knn, knn_vectors
from ..operators.scales import identify_scales
from ..operators.spectral import DEFAULT_SCALES, heat_filter
from ..sources.tables import write_tables
from .storage import save

RESOLUTIONS = [0.4, 0.6, 0.8, 1.0, 1.2]


def spatial_graph(points: DataFrame, k: int = 15, **how) -> DataFrame:
    return symmetrize(weigh(knn(points, k), k=k, **how))


def expression_graph(reps: DataFrame, k: int = 15) -> DataFrame:
    """No cap of 100 here: the largest finite weight is the cap."""
    return symmetrize(weigh(knn_vectors(reps, k), k=k, cap=None))


class MultiscaleAnalysis:
    """Stages over points(cell_id, x, y) and reps {name: DataFrame(cell_id, vec)}; a stage that has
    its result is skipped by the pipeline."""

    def __init__(self, points: DataFrame, reps: dict[str, DataFrame], run_label: str = "sample", path: str | None = None):
        self.points, self.reps, self.run_label, self.path = points, reps, run_label, path
        self.rep = self.scales = self.edges = self.signals = self.correlation = self.blocks = self.typical_scales = None
        self.labels = self.layouts = self.cell_simpson = self.simpson = None
        self.n_neighbors = 10

    def _rep(self, name: str) -> DataFrame:
        if name not in self.reps:
            raise ValueError(f"no representation {name!r}; there are {sorted(self.reps)}")
        return self.reps[name]

    def multiscale_transform(self, use_rep: str = "X_nmf", scales: list[float] | None = None, n_neighbors: int = 10) -> DataFrame:
        self.rep, self.n_neighbors = use_rep, n_neighbors
        rep = self._rep(use_rep)
        self.scales = list(scales) if scales is not None else DEFAULT_SCALES
        self.edges = save(spatial_graph(self.points, n_neighbors), "spatial-knn")
        out = heat_filter(self.edges, rep, self.scales, points=self.points)
        if self.path:
            where = f"{self.path}/{self.run_label}_transformed_signals"
            out.write.mode("overwrite").partitionBy("scale_idx").parquet(where)
            self.signals = self.points.sparkSession.read.parquet(where)
        else:
            self.signals = save(out, "signals")
        return self.signals

    def identify_typical_scales(self, max_clusters: int = 10, min_clusters: int = 3, dedupe: bool = True) -> DataFrame:
        if self.signals is None:
            raise ValueError("run multiscale_transform first")
        self.correlation, self.blocks, self.typical_scales = identify_scales(self.signals, self.scales, min_clusters, max_clusters, dedupe)
        if self.path:
            self.typical_scales.select(F.col("idx").alias("Index"), F.col("scale").alias("Scale")).write.mode("overwrite").csv(f"{self.path}/{self.run_label}_typical_scales", header=True)
        return self.typical_scales

    def clustering(self, n_metacells: int = 10_000, resolutions: list[float] | None = None, min_scale: float | None = None, max_scale: float | None = None) -> DataFrame:
        if self.typical_scales is None:
            raise ValueError("run identify_typical_scales first")
        resolutions = [float(r) for r in resolutions or RESOLUTIONS]
        picked = filter_scales(self.typical_scales, min_scale, max_scale)
        raw = two_step(self._rep(self.rep), resolutions, n_metacells)
        parts = [raw]
        chosen = sorted({(r.idx, r.scale) for r in picked.collect()})
        if chosen:
            parts.append(two_step_scales(self.signals, chosen, resolutions, n_metacells))
        union = lambda key: parts[0][key] if len(parts) == 1 else parts[0][key].unionByName(parts[1][key])
        self.labels, self.layouts = save(union("labels"), "labels"), save(union("layout"), "layouts")
        if self.path:
            union("centers").write.mode("overwrite").partitionBy("title").parquet(f"{self.path}/{self.run_label}_object_kmeans")
        return self.labels

    def simpson_by_scale(self, resolution: float | None = None) -> DataFrame:
        if self.labels is None:
            raise ValueError("run clustering first")
        resolution = resolution if resolution is not None else self.labels.agg(F.max("resolution")).first()[0]
        labels = self.labels.filter(F.col("resolution") == resolution)
        expr = save(expression_graph(self._rep(self.rep), self.n_neighbors), "expr-knn")
        self.simpson = mean_simpson(self.edges, expr, labels)
        self.cell_simpson = lambda title: simpson_indices(self.edges, expr, labels.filter(F.col("title") == title))
        return self.simpson

    def perform_multiscale_pipeline(self, use_rep: str = "X_nmf", n_metacells: int = 10_000, n_neighbors: int = 10, scales: list[float] | None = None, resolutions: list[float] | None = None, max_clusters: int = 10, min_clusters: int = 3, min_scale: float | None = None, max_scale: float | None = None) -> DataFrame:
        if self.signals is None:
            self.multiscale_transform(use_rep, scales, n_neighbors)
        if self.typical_scales is None:
            self.identify_typical_scales(max_clusters, min_clusters)
        if self.labels is None:
            self.clustering(n_metacells, resolutions, min_scale, max_scale)
        return self.simpson_by_scale()

    def write(self, path: str) -> list[str]:
        """All tables that the analysis has so far, a folder each; their names."""
        found = {"points": self.points, "spatial_knn": self.edges, "signals": self.signals, "typical_scales": self.typical_scales, "labels": self.labels, "layouts": self.layouts, "simpson": self.simpson}
        found = {k: v for k, v in found.items() if v is not None} | {f"rep_{k}": v for k, v in self.reps.items()}
        write_tables(found, path)
        return sorted(found)

    def cluster_points(self, resolution: float, title: str = "Raw") -> DataFrame:
        """What a plot of clusters in space or layout draws."""
        if self.labels is None:
            raise ValueError("run clustering first")
        own = self.labels.filter((F.col("title") == title) & (F.col("resolution") == resolution))
        return own.join(self.points, "cell_id").join(self.layouts.filter(F.col("title") == title).drop("title"), "cell_id")


def filter_scales(typical: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Both ends included, each optional."""
    if low is not None:
        typical = typical.filter(F.col("scale") >= low)
    if high is not None:
        typical = typical.filter(F.col("scale") <= high)
    return typical


def scales_of_titles(layouts: DataFrame, most: float | None = None) -> DataFrame:
    """scale of titles 'scale<s>', ascending, optionally up to `most`."""
    s = F.regexp_extract("title", r"^scale([0-9.eE+-]+)$", 1)
    out = layouts.select(F.when(s != "", s).cast("double").alias("scale")).filter("scale IS NOT NULL").distinct()
    return (out if most is None else out.filter(F.col("scale") <= most)).orderBy("scale")
