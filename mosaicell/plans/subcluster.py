"""Discovery of spatially dependent sub-populations of one cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import knee
from ..operators import subcluster as S
from ..operators.composition import composition
from ..operators.graph import symmetrize, weigh
from ..operators.neighbors import knn
from .storage import save

#: Larger scales blur what this analysis looks for.
MAX_SCALE = 10.0


class SubclusterAnalysis:
    """cells(cell_id, x, y, label), layouts(title, cell_id, u1, u2) with titles 'Raw' and
    'scale<s>', expression(cell_id, gene, value), log-normalised. Set `selected` to a label."""

    def __init__(self, cells: DataFrame, layouts: DataFrame, expression: DataFrame, path: str | None = None):
        self.cells, self.expression, self.path = cells, expression, path
        scale = F.when(F.col("title") == "Raw", 0.0).otherwise(F.regexp_extract("title", r"^scale(.+)$", 1).try_cast("double"))
        self.layouts = layouts.withColumn("scale", scale).filter(F.col("scale") <= MAX_SCALE)
        self.selected = self.variance = self.slopes = self.optimal_scale = self.subclusters = None

    def calculate_metrics(self, nonepi: bool = True) -> DataFrame:
        """cluster, slope; the suggested cluster is the last."""
        layout = self.layouts.join(self.cells.select("cell_id", F.col("label").alias("cluster")), "cell_id")
        if nonepi:
            layout = S.without_terms(layout, "cluster")
        self.variance = save(S.cluster_variance(layout), "variance")
        self.slopes = S.variance_slopes(self.variance).orderBy("slope")
        return self.slopes

    def suggested_cluster(self) -> str | None:
        if self.slopes is None:
            self.calculate_metrics()
        return self.slopes.agg(F.max_by("cluster", "slope")).first()[0]

    def _selected(self) -> str:
        if self.selected is None:
            raise ValueError("set `selected` to a label first")
        return self.selected

    def find_optimal_scale(self) -> float:
        """The elbow of the cluster's variance over scales; the largest scale without one."""
        if self.variance is None:
            self.calculate_metrics()
        rows = self.variance.filter(F.col("cluster") == self._selected()).orderBy("scale").collect()
        if not rows:
            raise ValueError(f"no metrics for {self.selected!r}; it may have been left out by name")
        x, y = [r.scale for r in rows], [r.variance for r in rows]
        found = knee(list(range(len(x))), y, "concave", "increasing", 0.1, online=True)
        self.optimal_scale = x[int(found)] if found is not None else x[-1]
        return self.optimal_scale

    def detect_subclusters(self, n_clusters: int = 2, ward: bool = True) -> DataFrame:
        """cell_id, sub (without outliers); `ward_costs` holds the cost at each scale."""
        if self.optimal_scale is None:
            self.find_optimal_scale()
        own = self.cells.filter(F.col("label") == self._selected()).select("cell_id")
        layout = self.layouts.join(own, "cell_id", "left_semi").select("scale", "cell_id", F.array("u1", "u2").alias("vec"))
        at = layout.filter(F.col("scale") == self.optimal_scale).select("cell_id", "vec")
        labels = S.density_peaks(at, n_clusters).select("cell_id", F.col("label").cast("string").alias("sub"))
        self.subclusters = save(labels.filter("sub <> '-1'"), "subclusters")
        self.ward_costs = None
        if ward:
            rows = layout.join(self.subclusters.withColumnRenamed("sub", "label"), "cell_id")
            for s in sorted(r[0] for r in rows.select("scale").distinct().collect()):
                one = S.ward_cost(rows.filter(F.col("scale") == s)).select(F.lit(s).alias("scale"), "cost")
                self.ward_costs = one if self.ward_costs is None else self.ward_costs.unionByName(one)
        return self.subclusters

    def _subclusters(self) -> DataFrame:
        return self.subclusters if self.subclusters is not None else self.detect_subclusters()

    def deg_analysis_subclusters(self, all_genes: bool = False) -> DataFrame:
        """Genes of the sub-clusters against each other, kept if up in the parent cluster too."""
        groups = self._subclusters().select("cell_id", F.col("sub").alias("grp"))
        own = self.expression.join(groups.select("cell_id"), "cell_id", "left_semi")
        deg = save(S.rank_genes(own, groups), "deg")
        parent = S.rank_genes(self.expression, self.cells.select("cell_id", F.col("label").alias("grp")), pvalues=False)
        parent = parent.filter(F.col("grp") == self._selected()).select("gene", F.col("logfc").alias("parent_logfc"))
        if self.path:
            deg.join(parent, "gene", "left").write.mode("overwrite").partitionBy("grp").csv(f"{self.path}/DEGs", header=True)
        return deg if all_genes else S.noise_filtered(deg, parent)

    def dot_plot(self, k: int = 6) -> DataFrame:
        groups = self._subclusters().select("cell_id", F.col("sub").alias("grp"))
        return S.top_genes(self.deg_analysis_subclusters(), self.expression, groups, k)

    def merged_labels(self, drop_outliers: bool = True) -> DataFrame:
        out = S.merge_labels(self.cells.select("cell_id", "label"), self._subclusters(), drop_outliers)
        if self.path:
            out.withColumnRenamed("label", "group").write.mode("overwrite").csv(f"{self.path}/Cell_clusters", header=True)
        return out

    def neighborhood_analysis(self, k: int = 10) -> DataFrame:
        """sub, label, mean_p of the neighbourhoods of each sub-cluster's cells, frequent labels only."""
        edges = symmetrize(weigh(knn(self.cells.select("cell_id", "x", "y"), k), "reciprocal", k, None, float("inf")))
        comp = composition(edges, self.cells.select("cell_id", "label"))
        own = comp.join(self._subclusters().select(F.col("cell_id").alias("src"), "sub"), "src")
        kept = S.frequent_neighbors(own.select("src", "label", "p"))
        sizes = own.groupBy("sub").agg(F.countDistinct("src").alias("n"))
        return own.join(kept.select("label"), "label", "left_semi").groupBy("sub", "label").agg(F.sum("p").alias("s")).join(sizes, "sub").select("sub", "label", (F.col("s") / F.col("n")).alias("mean_p"))

    def morphology_analysis(self, morphology: DataFrame, most: float = 0.05) -> DataFrame:
        """feature, t, df, pval of the sub-clusters '0' and '1' where pval < most."""
        return S.welch(morphology, self._subclusters().select("cell_id", F.col("sub").alias("grp"))).filter(F.col("pval") < most)

    def kde_points(self, most: int = 10_000, seed: int = 0) -> DataFrame:
        """The layout points of the selected cluster, at most `most`, for a density plot."""
        own = self.cells.filter(F.col("label") == self._selected()).select("cell_id")
        own = own.orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").limit(most)
        return self.layouts.join(own, "cell_id", "left_semi").select("scale", "cell_id", "u1", "u2")
