"""Neighbourhood composition and Simpson purity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def composition(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges(src, dst, weight), labels(cell_id, label) -> src, label, p: shares of the neighbours'
    labels by weight. A null label counts as one more class. Absent pairs have share 0."""
    sums = edges.join(labels.select(F.col("cell_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy("src"))
    return sums.withColumn("total", total).filter("total <> 0").select("src", "label", (F.col("w") / F.col("total")).alias("p"))


def simpson(comp: DataFrame) -> DataFrame:
    """cell_id, simpson: the sum of squared shares."""
    return comp.groupBy(F.col("src").alias("cell_id")).agg(F.sum(F.col("p") * F.col("p")).alias("simpson"))


def simpson_indices(spatial: DataFrame, expr: DataFrame, labels: DataFrame) -> DataFrame:
    """cell_id, spatial, transcriptomic, ratio, over binary graphs. labels(cell_id, label)."""
    graphs = spatial.select(F.lit("spatial").alias("graph"), "src", "dst").unionByName(expr.select(F.lit("transcriptomic").alias("graph"), "src", "dst"))
    counts = graphs.join(labels.select(F.col("cell_id").alias("dst"), "label"), "dst").groupBy("graph", "src", "label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("graph", "src"))
    each = counts.withColumn("p", share).groupBy("graph", "src").agg(F.sum(F.col("p") * F.col("p")).alias("s"))
    wide = each.groupBy(F.col("src").alias("cell_id")).agg(*[F.max(F.when(F.col("graph") == g, F.col("s"))).alias(g) for g in ("spatial", "transcriptomic")])
    return wide.withColumn("ratio", F.try_divide("spatial", "transcriptomic"))


def mean_simpson(spatial: DataFrame, expr: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(title, cell_id, label) -> title, spatial, transcriptomic: means over cells."""
    graphs = spatial.select(F.lit("spatial").alias("graph"), "src", "dst").unionByName(expr.select(F.lit("transcriptomic").alias("graph"), "src", "dst"))
    counts = graphs.join(labels.select("title", F.col("cell_id").alias("dst"), "label"), "dst").groupBy("graph", "title", "src", "label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("graph", "title", "src"))
    each = counts.withColumn("p", share).groupBy("graph", "title", "src").agg(F.sum(F.col("p") * F.col("p")).alias("s"))
    return each.groupBy("title").agg(*[F.avg(F.when(F.col("graph") == g, F.col("s"))).alias(g) for g in ("spatial", "transcriptomic")])
