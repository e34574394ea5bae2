"""Counts in coordinate form: quality metrics, normalisation, clipping, scaling.

Zeros are implicit throughout; every operator here maps zero to zero or works on moments, so the
table never becomes dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def qc_metrics(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum("value").alias("total_counts"), F.count_if(F.col("value") > 0).alias("n_genes_by_counts"))


def normalize_total(expr: DataFrame, target: float | None = None) -> DataFrame:
    """Each cell scaled to one total: the given one, or the median of the positive totals. The
    counts stay in the column `counts`."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    if target is None:
        goal = totals.filter("total > 0").agg(F.percentile("total", 0.5).alias("goal"))
        totals = totals.crossJoin(F.broadcast(goal))  # one row
    else:
        totals = totals.withColumn("goal", F.lit(float(target)))
    scaled = F.when(F.col("total") > 0, F.col("value") * F.col("goal") / F.col("total")).otherwise(F.col("value"))
    return expr.join(totals, "cell_id").withColumn("counts", F.col("value")).withColumn("value", scaled).drop("total", "goal")


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def expm1(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.expm1("value"))


def preprocess(expr: DataFrame) -> DataFrame:
    """cell_id, gene, value (log-normalised), counts."""
    return log1p(normalize_total(expr))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (0-based), n: equal widths between the extremes, the last bin closed."""
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).otherwise(0)
    return df.filter(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def qc_histograms(cells: DataFrame, bins: int = 50) -> DataFrame:
    """metric, bin, n for those of the usual metrics that cells has, and nucleus / cell area."""
    metrics = {c: F.col(c) for c in ("total_counts", "n_genes_by_counts", "cell_area") if c in cells.columns}
    if {"nucleus_area", "cell_area"} <= set(cells.columns):
        metrics["nucleus_ratio"] = F.try_divide(F.col("nucleus_area"), F.col("cell_area"))
    parts = [histogram(cells.select(c.alias("v")), "v", bins).select(F.lit(n).alias("metric"), "bin", "n") for n, c in metrics.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantile_clip(expr: DataFrame, q: float = 0.9999) -> DataFrame:
    """Values above the quantile of the non-zero values (of all, if none is) become it."""
    limit = expr.agg(F.coalesce(F.percentile(F.when(F.col("value") != 0, F.col("value")), q), F.percentile("value", q)).alias("limit"))
    return expr.crossJoin(F.broadcast(limit)).withColumn("value", F.least("value", "limit")).drop("limit")


def gene_stats(expr: DataFrame, n_cells: int | None = None) -> DataFrame:
    """gene, mean, std (sample), zeros included, from sums over the stored values."""
    if n_cells is None:
        count = expr.agg(F.countDistinct("cell_id").cast("double").alias("n"))
    else:
        count = expr.sparkSession.range(1).select(F.lit(float(n_cells)).alias("n"))
    sums = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    n = F.col("n")
    var = F.greatest(F.lit(0.0), (F.col("s2") - F.col("s") * F.col("s") / n) / F.greatest(n - 1, F.lit(1.0)))
    return sums.crossJoin(F.broadcast(count)).select("gene", (F.col("s") / n).alias("mean"), F.sqrt(var).alias("std"))


def nonnegative(df: DataFrame, strategy: str = "shift", column: str = "value") -> DataFrame:
    if strategy == "clip":
        return df.withColumn(column, F.greatest(F.col(column), F.lit(0.0)))
    if strategy != "shift":
        raise ValueError("strategy must be 'shift' or 'clip'")
    low = df.agg(F.least(F.min(column), F.lit(0.0)).alias("_low"))
    return df.crossJoin(F.broadcast(low)).withColumn(column, F.col(column) - F.col("_low")).drop("_low")


def standardize(df: DataFrame, id_column: str = "cell_id", vec: str = "vec") -> DataFrame:
    """id, vec: the vectors' columns brought to mean 0 and population deviation 1, constant ones to 0.

    The moments are one row, so that no vector is taken apart and put together again."""
    moments = df.select(F.posexplode(vec).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    moments = moments.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "sd"))).alias("_moments"))
    at = lambda i: F.col("_moments")[i]
    z = F.transform(vec, lambda v, i: (v - at(i)["m"]) / F.when(at(i)["sd"] > 0, at(i)["sd"]).otherwise(1.0))
    return df.crossJoin(F.broadcast(moments)).select(id_column, z.alias(vec))
