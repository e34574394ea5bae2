"""Weighted graphs as edge tables: weightings, symmetry, degrees, Laplacian, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import save

FACTOR, CAP = 100.0, 100.0
WEIGHTINGS = ("reciprocal", "gaussian", "uniform", "ranked", "connectivity")


def weigh(nbrs: DataFrame, weighting: str = "reciprocal", k: int | None = None, pattern: str | None = "auto", cap: float | None = CAP, factor: float = FACTOR, sigma: float | None = None) -> DataFrame:
    """nbrs(src, dst, rank, dist) -> src, dst, weight, one row a directed edge.

    reciprocal: factor / dist, at most cap (None: at most the largest finite-looking weight); with
    pattern 'auto' the factor is five times the median distance. The other schemes are scaled so
    that their median is 5 under 'auto'."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting must be one of {WEIGHTINGS}")
    auto, d = pattern == "auto", F.col("dist")
    own = Window.partitionBy("src")
    if weighting == "reciprocal":
        base = nbrs.withColumn("f", F.lit(float(factor)))
        if auto:
            base = nbrs.crossJoin(F.broadcast(nbrs.agg((5 * F.percentile("dist", 0.5)).alias("f"))))
        w = base.withColumn("weight", F.col("f") / (d + 1e-10)).select("src", "dst", "weight")
        if cap is not None:
            return w.withColumn("weight", F.least("weight", F.lit(float(cap))))
        top = w.agg(F.max(F.when(F.col("weight") < 1e10, F.col("weight"))).alias("top"))
        return w.crossJoin(F.broadcast(top)).select("src", "dst", F.least("weight", F.coalesce("top", "weight")).alias("weight"))
    if weighting == "gaussian":
        if sigma is None:
            middle = nbrs.groupBy("src").agg(F.percentile("dist", 0.5).alias("m"))
            base = nbrs.join(middle, "src")
        else:
            base = nbrs.withColumn("m", F.lit(float(sigma)))
        z = F.try_divide(d, F.col("m"))
        w = base.withColumn("weight", F.exp(-z * z))
    elif weighting == "uniform":
        w = nbrs.withColumn("weight", F.lit(1.0))
    elif weighting == "ranked":
        k = F.lit(k) if k else F.max("rank").over(own)
        z = 1.5 * F.col("rank") / k
        w = nbrs.withColumn("weight", F.exp(-z * z))
    else:
        w = nbrs.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d / (F.max("dist").over(own) + 1e-10))))
    w = w.select("src", "dst", "weight")
    if auto:
        w = w.crossJoin(F.broadcast(w.agg(F.percentile("weight", 0.5).alias("mid")))).select("src", "dst", (F.try_divide(F.lit(5.0), F.col("mid")) * F.col("weight")).alias("weight"))
    return w


def symmetrize(edges: DataFrame) -> DataFrame:
    """An edge in either direction becomes one in both, with the larger weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionAll(back).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def binarize(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("cell_id")).agg(F.sum("weight").alias("degree"))


def laplacian_apply(edges: DataFrame, x: DataFrame) -> DataFrame:
    """x(cell_id, value) -> cell_id, value of (D - W) x."""
    flow = edges.join(x.withColumnRenamed("cell_id", "dst"), "dst").groupBy("src").agg(F.sum(F.col("weight") * F.col("value")).alias("flow"), F.sum("weight").alias("degree"))
    out = x.join(flow.withColumnRenamed("src", "cell_id"), "cell_id", "left")
    return out.select("cell_id", (F.coalesce("degree", F.lit(0.0)) * F.col("value") - F.coalesce("flow", F.lit(0.0))).alias("value"))


#: Counted edges between joined nodes that one task unites.
LOCAL_EDGES = 1_000_000


def _united(kind: pa.DataType):
    """In a task, of at most LOCAL_EDGES edges: node, root (least id). Roots hook on to lesser ones, and nodes jump to their roots."""

    def run(table: pa.Table) -> pa.Table:
        ids = pc.unique(pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], kind))
        ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(table[c], ids).to_numpy().astype(np.int64) for c in ("src", "dst"))
        root = np.arange(len(ids))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, root[root]):
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        return pa.Table.from_arrays([ids, ids.take(pa.array(root))], names=["node", "root"])

    return run


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """cell_id, component (least id). Nodes join their least neighbour and jump on to its root, and edges are kept between
    roots only, until so few are left (at most LOCAL_EDGES, counted) that one task unites them. Labels are as many as nodes, so
    no join may send them through the driver."""
    ends = (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    ids = edges.select(F.col("src").alias("cell_id")).unionAll(edges.select("dst")).distinct() if nodes is None else nodes.select("cell_id")
    left, joined = save(edges.select(*ends).filter("src < dst").distinct(), "cc-edges"), []
    while left.count() > LOCAL_EDGES:
        both = left.unionAll(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = save(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root")).withColumn("root", F.least("node", "root")), "cc-up")
        while True:
            further = up.select(F.col("node").alias("root"), F.col("root").alias("further")).hint("merge")
            new = save(up.join(further, "root").select("node", F.col("root").alias("old"), F.col("further").alias("root")), "cc-up")
            up = new.drop("old")
            if not new.filter("old <> root").limit(1).count():
                break
        joined.append(up)
        for c in ("src", "dst"):
            left = left.join(up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge"), c)
        left = save(left.select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).select(*ends).filter("src < dst").distinct(), "cc-edges")
    kind = left.schema["src"].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    joined.append(save(left.groupBy(F.lit(0).alias("all")).applyInArrow(_united(arrow), f"node {kind.simpleString()}, root {kind.simpleString()}"), "cc-last"))
    labels = ids.withColumn("component", F.col("cell_id"))
    for up in joined:
        labels = labels.join(up.withColumnRenamed("node", "component").hint("merge"), "component", "left").select("cell_id", F.coalesce("root", "component").alias("component"))
    return save(labels, "cc")


def check(edges: DataFrame, nodes: DataFrame) -> dict[str, bool | float]:
    """Connected, symmetric, least weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"))
    lone = edges.join(back.hint("merge"), ["src", "dst"], "left").filter("w2 IS NULL OR w2 <> weight").limit(1).count()
    parts = components(edges, nodes).agg(F.countDistinct("component")).first()[0]
    return {"connected": parts <= 1, "symmetric": not lone, "min_weight": edges.agg(F.min("weight")).first()[0]}


def median_similarity(edges: DataFrame) -> DataFrame:
    return edges.agg(F.percentile("weight", 0.5).alias("median_similarity"))
