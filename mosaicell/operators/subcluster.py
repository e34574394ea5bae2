"""Sub-populations: variance over scales, density peaks, Ward cost, differential tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import erfc, t_two_sided
from ..plans.storage import maybe_broadcast, save
from .neighbors import ASKING, GROUP_TASKS, MOST_TILES, PART, SAMPLED, TARGETS, Tiles, density, kth_distances

#: Points of a block that meets another in one task; of few points, up to eight blocks of FEW_BLOCK.
BLOCK, FEW_BLOCK = 8192, 1024
#: Distances that a task holds at a time, and those of vectors by a matrix product.
SLAB, PRODUCTS = 1 << 17, 1 << 19
#: Bins that the range of a k-th distance is cut into at a time.
BINS = 64

#: Points without one of a higher rho that are broadcast to meet all others.
FEW_OPEN = 1000

#: Name parts of cell types left out of the ranking by default.
EPITHELIAL_TERMS = ("Tumor Cells", "Epithelial", "Epithelium", "AT2", "Unassigned", "Ciliated", "Malignant")


def without_terms(df: DataFrame, column: str, terms=EPITHELIAL_TERMS) -> DataFrame:
    out = df
    for t in terms:
        out = out.filter(~F.contains(F.col(column), F.lit(t)))
    return out


def cluster_variance(layout: DataFrame) -> DataFrame:
    """layout(cell_id, cluster, scale, u1, u2) -> cluster, scale, variance: both axes scaled by the
    common extremes of the scale, population variances averaged."""
    ends = layout.groupBy("scale").agg(F.min(F.least("u1", "u2")).alias("lo"), F.max(F.greatest("u1", "u2")).alias("hi"))
    z = lambda c: F.try_divide(F.col(c) - F.col("lo"), F.col("hi") - F.col("lo"))
    return layout.join(F.broadcast(ends), "scale").groupBy("cluster", "scale").agg(((F.var_pop(z("u1")) + F.var_pop(z("u2"))) / 2).alias("variance"))


def variance_slopes(variance: DataFrame) -> DataFrame:
    """cluster, slope of variance over scale; the greatest is the suggested cluster."""
    return variance.groupBy("cluster").agg(F.regr_slope("variance", "scale").alias("slope"))


# ------------------------------------------------------------------ density peaks


def _blocks(points: DataFrame, n: int) -> DataFrame:
    """id, vec and further columns, each once for every pair of blocks that its own is in, as the
    asking side (asks) or the other. A block holds about BLOCK points, and a group is one pair."""
    count = max(1, -(-n // BLOCK), min(8, -(-n // FEW_BLOCK)))
    held = points.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(count)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    asking = held.select("*", F.lit(True).alias("asks"), F.struct(F.col("own").alias("a"), F.col("other").alias("b")).alias("pair"))
    asked = held.select("*", F.lit(False).alias("asks"), F.struct(F.col("other").alias("a"), F.col("own").alias("b")).alias("pair"))
    return asking.unionAll(asked).drop("own", "other").groupBy("pair.a", "pair.b")


class _Pairs:
    """Of the pairs of two blocks: some asking rows, all asked rows in order of id, and their squared distances by a matrix
    product, which are right up to `slack`. Where that does not settle a question, `exact` does."""

    def __init__(self, part: pd.DataFrame, right: pd.DataFrame, v: np.ndarray, m: np.ndarray, rough: np.ndarray, slack: float):
        self.part, self.right, self.v, self.m, self.rough, self.slack = part, right, v, m, rough, slack

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of row i and asked row j, term by term in the order of the vector."""
        found = np.zeros(len(i))
        for at in range(0, len(i), SLAB):
            own = slice(at, at + SLAB)
            squares = found[own]
            for k in range(self.v.shape[1]):
                away = self.v[i[own], k] - self.m[j[own], k]
                squares += away * away
        return np.sqrt(found)

    def between(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs whose distance may be from lo up to hi, by row."""
        least, most = np.maximum(lo, 0) ** 2 * (1 - 1e-9) - self.slack, hi**2 * (1 + 1e-9) + self.slack
        return np.nonzero((self.rough >= least[:, None]) & (self.rough <= most[:, None]))


def _slabs(both: pd.DataFrame):
    left, right = both[both["asks"]], both[~both["asks"]].sort_values("id")
    if not len(left) or not len(right):
        return
    m = np.stack(right["vec"].to_numpy()).astype(float)
    center = m.mean(0)
    own_m = m - center
    squares_m = (own_m * own_m).sum(1)
    step = max(1, PRODUCTS // len(m))
    for s in range(0, len(left), step):
        part = left.iloc[s : s + step]
        v = np.stack(part["vec"].to_numpy()).astype(float)
        own_v = v - center
        squares_v = (own_v * own_v).sum(1)
        rough = squares_v[:, None] + squares_m - 2 * (own_v @ own_m.T)
        slack = 1e-14 * (v.shape[1] + 16) * float(squares_v.max() + squares_m.max() + np.abs(center).max() ** 2)
        yield _Pairs(part, right, v, m, rough, slack)


def _top(both: pd.DataFrame) -> pd.DataFrame:
    most = [float(p.exact(*np.nonzero(p.rough >= p.rough.max() - 2 * p.slack)).max(initial=0.0)) for p in _slabs(both)]
    return pd.DataFrame({"top": [max(most, default=0.0)]})


def _within(cutoff: float, top: float):
    def run(both: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": both["id"][:0], "k": np.zeros(0, int)})]
        for p in _slabs(both):
            if top:
                at = np.full(len(p.part), cutoff * top)
                i, j = p.between(at * (1 - 1e-9), at * (1 + 1e-9))
                k = (p.rough < at[:, None] ** 2).sum(1) - np.bincount(i, p.rough[i, j] < at[i] ** 2, len(at)).astype(int)
                k += np.bincount(i, p.exact(i, j) / top < cutoff, len(at)).astype(int)
            else:
                k = np.full(len(p.part), p.rough.shape[1] if cutoff > 0 else 0)
            found.append(pd.DataFrame({"id": p.part["id"], "k": k}))
        return pd.concat(found[1:] or found)

    return run


def _binned(both: pd.DataFrame) -> pd.DataFrame:
    """For each asking point, how many asked ones are in each bin of its range from lo up to hi."""
    found = [pd.DataFrame({"id": both["id"][:0], "bins": pd.Series([], dtype=object)})]
    for p in _slabs(both):
        lo, hi = p.part["lo"].to_numpy(), p.part["hi"].to_numpy()
        row, col = p.between(lo, hi)
        edges, d = _edges(lo, hi), np.sqrt(np.maximum(p.rough[row, col], 0))
        # near an edge, or where an error of the square is a large one of the root, the exact distance decides
        wide = (hi - lo) / BINS
        off = (d - lo[row]) / wide[row]
        error = p.slack / np.maximum(d, 1e-300) + 1e-12 * d
        near = np.flatnonzero((np.abs(off - np.rint(off)) * wide[row] <= 2 * error + 1e-12 * hi[row]) | (d * d <= 1e6 * p.slack))
        d[near] = p.exact(row[near], col[near])
        inside = (d >= lo[row]) & (d < hi[row])
        row, d = row[inside], d[inside]
        at = np.clip((d - lo[row]) * (BINS / (hi - lo))[row], 0, BINS - 1).astype(int)
        at = np.clip(at - (d < edges[row, at]) + (d >= edges[row, at + 1]), 0, BINS - 1)
        found.append(pd.DataFrame({"id": p.part["id"].to_numpy(), "bins": list(np.bincount(row * BINS + at, minlength=len(p.part) * BINS).reshape(-1, BINS))}))
    return pd.concat(found[1:] or found, ignore_index=True)


def _edges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    edges = lo[:, None] + np.arange(BINS + 1) * ((hi - lo) / BINS)[:, None]
    edges[:, -1] = hi
    return edges


def _narrowed(batches):
    """The bin of a range in which the one of rank `nth` lies, and its rank in there."""
    for batch in batches:
        if len(batch):
            upto = np.cumsum(np.stack(batch["bins"].to_numpy()), 1)
            nth, rows = batch["nth"].to_numpy(), np.arange(len(batch))
            at, edges = (upto <= nth[:, None]).sum(1), _edges(batch["lo"].to_numpy(), batch["hi"].to_numpy())
            below = np.where(at > 0, upto[rows, at - 1], 0)
            yield pd.DataFrame({"id": batch["id"], "lo": edges[rows, at], "hi": edges[rows, at + 1], "nth": nth - below})


def _in_range(both: pd.DataFrame) -> pd.DataFrame:
    """For each asking point the distances in its range, equal ones once with their number."""
    found = [pd.DataFrame({"id": both["id"][:0], "d": np.zeros(0), "c": np.zeros(0, int)})]
    for p in _slabs(both):
        lo, hi = p.part["lo"].to_numpy(), p.part["hi"].to_numpy()
        row, col = p.between(lo, hi)
        d = p.exact(row, col)
        inside = (d >= lo[row]) & (d < hi[row])
        each = pd.DataFrame({"id": p.part["id"].to_numpy()[row[inside]], "d": d[inside]})
        found.append(each.groupby(["id", "d"], sort=False).size().reset_index(name="c"))
    return pd.concat(found[1:] or found, ignore_index=True)


def _kth_of_vectors(p: DataFrame, n: int, k: int, top: float) -> DataFrame:
    """id, d to the k-th nearest other of p(id, vec), exact, without a table of neighbours: counts by bin narrow each
    point's range until it holds few distances, and only these leave their tasks."""
    kind = p.schema["id"].dataType.simpleString()
    ranges = p.select("id", F.lit(0.0).alias("lo"), F.lit(float(np.nextafter(top, np.inf))).alias("hi"), F.lit(k).cast("long").alias("nth"))
    for _ in range(max(1, math.ceil(math.log(max(2, n / 32), BINS)))):
        counted = _blocks(p.join(ranges.drop("nth"), "id"), n).applyInPandas(_binned, f"id {kind}, bins array<long>")
        sums = counted.groupBy("id").agg(F.array(*[F.sum(F.get("bins", F.lit(i))) for i in range(BINS)]).alias("bins"))
        ranges = save(save(sums, "kth-bins").join(ranges, "id").mapInPandas(_narrowed, f"id {kind}, lo double, hi double, nth long"), "kth-ranges")
    left = _blocks(p.join(ranges.drop("nth"), "id"), n).applyInPandas(_in_range, f"id {kind}, d double, c long")
    left = save(left.groupBy("id", "d").agg(F.sum("c").alias("c")), "kth-left")
    upto = F.sum("c").over(Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return left.withColumn("upto", upto).join(ranges.select("id", "nth"), "id").filter(F.col("upto") > F.col("nth")).groupBy("id").agg(F.min("d").alias("d"))


def _uphill(both: pd.DataFrame) -> pd.DataFrame:
    """For each asking point the nearest asked one of a higher rho, ties by id, and the farthest."""
    found = [pd.DataFrame({"id": both["id"][:0], "d": np.zeros(0), "up": both["id"][:0], "far": np.zeros(0)})]
    for p in _slabs(both):
        n = len(p.part)
        i, j = np.nonzero(p.rough >= p.rough.max(1, keepdims=True) - 2 * p.slack)
        far = np.zeros(n)
        np.maximum.at(far, i, p.exact(i, j))
        higher = np.where(p.right["rho"].to_numpy()[None] > p.part["rho"].to_numpy()[:, None], p.rough, np.inf)
        i, j = np.nonzero((higher <= higher.min(1, keepdims=True) + 2 * p.slack) & (higher < np.inf))
        d = p.exact(i, j)
        first = np.lexsort((j, d, i))
        first = first[np.flatnonzero(np.diff(i[first], prepend=-1))]
        least, at = np.full(n, np.inf), np.zeros(n, int)
        least[i[first]], at[i[first]] = d[first], j[first]
        found.append(pd.DataFrame({"id": p.part["id"].to_numpy(), "d": least, "up": p.right["id"].to_numpy()[at], "far": far}))
    return pd.concat(found[1:] or found, ignore_index=True)


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, in order around it."""
    pts = np.unique(xy, axis=0).tolist()
    half = []
    for way in (pts, pts[::-1]):
        chain: list = []
        for x, y in way:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (x - chain[-2][0]):
                chain.pop()
            chain.append((x, y))
        half += chain[: max(1, len(chain) - 1)]
    return np.array(half, float).reshape(-1, 2)


def _hulls(batches):
    for batch in batches:
        yield pd.DataFrame(_hull(batch[["x", "y"]].to_numpy(float)), columns=["x", "y"])


def _farthest(corners: pd.DataFrame) -> pd.DataFrame:
    h, top = _hull(corners[["x", "y"]].to_numpy(float)), 0.0
    for at in range(0, len(h), 1000):
        away = h[at : at + 1000, None] - h[None]
        top = max(top, float(np.sqrt(away[..., 0] * away[..., 0] + away[..., 1] * away[..., 1]).max()))
    return pd.DataFrame({"top": [top]})


def diameter(points: DataFrame) -> float:
    """The greatest distance of points(x, y): both ends are corners of the hull of the batches' hulls."""
    found = points.select("x", "y").mapInPandas(_hulls, "x double, y double").groupBy(F.lit(0).alias("g")).applyInPandas(_farthest, "top double").first()
    return found[0] if found else 0.0


def _noise(points: DataFrame, c: str, key: str = "cell_id") -> F.Column:
    whole = points.schema[key].dataType.simpleString() in ("int", "bigint")
    return F.pmod(F.col(c).cast("long") * 2654435761 if whole else F.xxhash64(c), F.lit(1 << 32)) / float(1 << 32) * 1e-5


def _largest_within(cutoff: float, top: float) -> float:
    """The greatest distance that is, divided by top, below the cutoff; a least one if that is 0."""
    d = cutoff * top
    while d / top >= cutoff:
        d = np.nextafter(d, 0)
    while np.nextafter(d, np.inf) / top < cutoff:
        d = np.nextafter(d, np.inf)
    return float(max(d, 1e-300))


def _higher(kind: pa.DataType):
    """In tasks, of some points and a rectangle's: the nearest of a higher rho, ties by id, where there is one."""
    schema = pa.schema([("cell_id", kind), ("d", pa.float64()), ("parent", kind)])

    def run(asking: pa.Table, targets: pa.Table) -> pa.Table:
        targets = targets.sort_by("cell_id")
        (ax, ay, ar), (bx, by, br) = ([t[c].to_numpy() for c in ("x", "y", "rho")] for t in (asking, targets))
        ids, names, step, made = asking["cell_id"].combine_chunks(), targets["cell_id"].combine_chunks(), max(1, SLAB // max(1, len(bx))), [schema.empty_table()]
        for at in range(0, len(ax) if len(bx) else 0, step):
            own = slice(at, at + step)
            dx, dy = ax[own, None] - bx, ay[own, None] - by
            d = np.where(br > ar[own, None], np.sqrt(dx * dx + dy * dy), np.inf)
            up = d.argmin(1)
            least = d[np.arange(len(up)), up]
            some = np.flatnonzero(least < np.inf)
            made.append(pa.Table.from_arrays([ids.take(pa.array(at + some)), pa.array(least[some]), names.take(pa.array(up[some]))], schema=schema))
        return pa.concat_tables(made)

    return run


def _uphill_in_plane(rho: DataFrame, n: int) -> DataFrame:
    """cell_id, rho, d, parent of the points of rho(cell_id, x, y, rho) that have one of a higher rho, by two passes over
    rectangles of about PART points: a point meets its own, then those as near as what it found that hold a higher rho.
    A task holds a block of either side and SLAB distances; no pair leaves it."""
    p = rho.filter("x = x AND y = y AND NOT isnan(x) AND NOT isnan(y)")
    kind = rho.schema["cell_id"].dataType.simpleString()
    count = max(1, min(MOST_TILES, n // PART))
    sample = p.orderBy(F.xxhash64("cell_id"), "cell_id").limit(SAMPLED * count).select("x", "y").toPandas().to_numpy(float)
    if not len(sample):
        return rho.select("cell_id", "rho", F.lit(0.0).alias("d"), F.col("cell_id").alias("parent")).limit(0)
    tiles = Tiles(sample, count)

    def assign(batches):
        for b in batches:
            yield b.assign(tile=tiles.assign(b[["x", "y"]].to_numpy(float))[0].astype(np.int32))

    held = save(p.select("cell_id", "x", "y", "rho").mapInPandas(assign, f"cell_id {kind}, x double, y double, rho double, tile int"), "peak-tiles")
    box = held.groupBy("tile").agg(F.count("*").alias("n"), F.max("rho").alias("top")).toPandas()  # a row a rectangle
    sizes, top = np.zeros(len(tiles.boxes), int), np.full(len(tiles.boxes), -np.inf)
    sizes[box["tile"]], top[box["tile"]] = box["n"], box["top"]
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def met(asking: DataFrame, asks: dict[int, int]) -> DataFrame:
        plan = F.broadcast(rho.sparkSession.createDataFrame([(t, -(-k // ASKING), max(1, -(-int(sizes[t]) // TARGETS))) for t, k in asks.items()], "tile int, salts int, blocks int"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("cell_id"), F.col(c)).cast("int")
        a = asking.select("cell_id", "x", "y", "rho", "tile").join(plan, "tile").withColumn("salt", own("salts")).withColumn("block", every("blocks"))
        # written under other names before, as cogrouped tables of one origin are ambiguous
        t = held.toDF(*held.columns).join(plan, "tile").withColumn("block", own("blocks")).withColumn("salt", every("salts"))
        tasks = max(1, min(GROUP_TASKS, sum(-(-k // ASKING) for k in asks.values())))
        keys = ["tile", "salt", "block"]
        a, t = (x.select("cell_id", "x", "y", "rho", *keys).repartition(tasks, *keys).groupBy(*keys) for x in (a, t))
        return a.cogroup(t).applyInArrow(_higher(arrow), f"cell_id {kind}, d double, parent {kind}")

    def visits(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                b = batch.iloc[at : at + 4096]
                i, j = tiles.visits(b[["x", "y"]].to_numpy(float), b["tile"].to_numpy(), b["d"].to_numpy(float))
                some = top[j] > b["rho"].to_numpy()[i]
                yield b.iloc[i[some]].drop(columns="d").assign(tile=j[some].astype(np.int32))

    near = save(met(held, {int(t): int(k) for t, k in enumerate(sizes) if k}).groupBy("cell_id").agg(F.min(F.struct("d", "parent")).alias("up")), "peak-own")
    bounds = held.join(near.select("cell_id", F.col("up.d").alias("d")), "cell_id", "left").withColumn("d", F.coalesce("d", F.lit(float("inf"))))
    visiting = save(bounds.select("cell_id", "x", "y", "rho", "tile", "d").mapInPandas(visits, f"cell_id {kind}, x double, y double, rho double, tile int"), "peak-visits")
    asks = {r[0]: r[1] for r in visiting.groupBy("tile").count().collect()}
    found = near.select("cell_id", "up.d", "up.parent")
    if asks:
        found = found.unionByName(met(visiting, asks))
    best = found.groupBy("cell_id").agg(F.min(F.struct("d", "parent")).alias("up"))
    return rho.select("cell_id", "rho").join(best, "cell_id").select("cell_id", "rho", F.col("up.d").alias("d"), F.col("up.parent").alias("parent"))


def _planar_tree(points: DataFrame, n: int, cutoff: float | None) -> DataFrame:
    """cell_id, rho, delta, parent of points in a plane: rho by counts within the cutoff, the nearest of a higher rho by
    rectangles. The highest are compared with all points by a broadcast."""
    p = save(points.select("cell_id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y")), "peak-points")
    top = diameter(p)
    if cutoff is None:
        k = max(n // 100, 1)
        cutoff = (kth_distances(p, k).agg(F.avg(F.col("dist") / (top or 1.0))).first()[0] or 0.0) if n > k else 0.0
    counts = p.select(F.col("cell_id").alias("src"), F.lit(0).alias("k"))
    if cutoff > 0 and top > 0:
        counts = density(p, _largest_within(cutoff, top)).select(F.col("cell_id").alias("src"), F.col("density").alias("k"))
    rho = p.join(counts, p["cell_id"] == counts["src"]).select("cell_id", "x", "y", (F.col("k") - 1 + _noise(points, "cell_id")).alias("rho"))
    rho = save(rho, "rho")
    done = save(_uphill_in_plane(rho, n), "peak-found")
    left = save(rho.join(done.select("cell_id"), "cell_id", "left_anti"), "peak-left")
    n_left = left.count()
    far = rho.select(F.col("cell_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("rho").alias("rj"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    d = F.sqrt(dx * dx + dy * dy)
    # the highest, and points without coordinates
    last = F.broadcast(left.select("cell_id", "x", "y", "rho")) if n_left <= FEW_OPEN else left.select("cell_id", "x", "y", "rho")
    rest = far.join(last).groupBy("cell_id", "rho").agg(F.min(F.when(F.col("rj") > F.col("rho"), F.struct(d.alias("d"), "j"))).alias("up"), F.max(d).alias("far"))
    rest = rest.select("cell_id", "rho", F.coalesce("up.d", "far").alias("d"), F.coalesce("up.j", "cell_id").alias("parent"))
    tree = done.unionByName(rest)
    return save(tree.select("cell_id", "rho", (F.col("d") / (top or 1.0)).alias("delta"), "parent"), "tree")


def _paired_tree(points: DataFrame, n: int, cutoff: float | None) -> DataFrame:
    """The same for vectors of any size: pairs are compared block by block and leave one row a point
    and pair of blocks. The default cutoff comes from the exact k-th distances of vectors."""
    p = save(points.select(F.col("cell_id").alias("id"), F.col("vec").cast("array<double>").alias("vec")), "peak-points")
    kind = p.schema["id"].dataType.simpleString()
    # each pass is written, so that its shuffle files go before the next
    top = (save(_blocks(p, n).applyInPandas(_top, "top double"), "peak-top").agg(F.max("top")).first()[0] or 0.0) if n else 0.0
    if cutoff is None:
        k = max(n // 100, 1)
        cutoff = (_kth_of_vectors(p, n, k, top).agg(F.avg(F.col("d") / (top or 1.0))).first()[0] or 0.0) if n > k and top else 0.0
    counts = save(_blocks(p, n).applyInPandas(_within(cutoff, top), f"id {kind}, k long"), "peak-counts").groupBy("id").agg(F.sum("k").alias("k"))
    rho = save(p.join(counts, "id").select("id", "vec", (F.col("k") - 1 + _noise(p, "id", "id")).alias("rho")), "rho")
    up = F.min(F.when(F.col("d") < float("inf"), F.struct("d", "up"))).alias("up")
    best = _blocks(rho, n).applyInPandas(_uphill, f"id {kind}, d double, up {kind}, far double").groupBy("id").agg(up, F.max("far").alias("far"))
    out = rho.select("id", "rho").join(best, "id")
    return save(out.select(F.col("id").alias("cell_id"), "rho", (F.coalesce("up.d", "far") / (top or 1.0)).alias("delta"), F.coalesce("up.up", "id").alias("parent")), "tree")


def density_peaks(points: DataFrame, n_clusters: int | None = 2, cutoff: float | None = None) -> DataFrame:
    """points(cell_id, vec) -> cell_id, rho, delta, parent, label (-1: outlier).

    Distances are relative to the greatest. rho counts points within the cutoff (by default the
    mean distance of the max(n // 100, 1)-th neighbour) and breaks ties by a hash of the id; delta
    is the distance to the nearest point of higher rho. Centres have the greatest rho * delta;
    labels follow parents to a centre, by pointer jumping."""
    n, planar = points.agg(F.count("*"), F.coalesce(F.bool_and(F.size("vec") == 2), F.lit(True))).first()
    tree = (_planar_tree if planar else _paired_tree)(points, n, cutoff)
    score = F.col("rho") * F.col("delta")
    if n_clusters is None:
        best = [r[0] for r in tree.select(score.alias("s")).orderBy(F.desc("s")).limit(n // 10 + 2).collect()]
        ratios = [a / b if b else float("inf") for a, b in zip(best[1:-1], best[2:], strict=False)][: max(1, n // 10)]
        n_clusters = ratios.index(max(ratios)) + 2 if ratios else 1
    # the n-th greatest score; equal ones are centres too
    least = tree.select(score.alias("s")).orderBy(F.desc("s")).limit(n_clusters).agg(F.min("s")).first()[0]
    centers = tree.filter(score >= F.lit(least)).select("cell_id") if least is not None else tree.select("cell_id").limit(0)
    centers = centers.withColumn("label", (F.row_number().over(Window.orderBy("cell_id")) - 1).cast("int"))
    centers = save(centers, "centers")
    at = save(tree.join(centers, "cell_id", "left").select("cell_id", F.when(F.col("label").isNotNull(), F.col("cell_id")).otherwise(F.col("parent")).alias("root")), "roots")
    while True:
        nxt = save(at.join(at.select(F.col("cell_id").alias("root"), F.col("root").alias("next")), "root").select("cell_id", F.col("root").alias("old"), F.col("next").alias("root")), "roots")
        moved = nxt.filter("old <> root").limit(1).count()
        at = nxt.select("cell_id", "root")
        if not moved:
            break
    out = tree.join(at, "cell_id").join(centers.select(F.col("cell_id").alias("root"), "label"), "root", "left")
    return out.select("cell_id", "rho", "delta", "parent", F.when(F.col("rho") <= 0, -1).otherwise(F.coalesce("label", F.lit(-1))).alias("label"))


# ------------------------------------------------------------------ centroids


def centroids(points: DataFrame) -> DataFrame:
    """points(label, vec) -> label, n, vec of means."""
    means = points.select("label", F.posexplode("vec").alias("dim", "v")).groupBy("label", "dim").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("vec"))


def ward_cost(points: DataFrame) -> DataFrame:
    """The least cost of merging two labels, n1 n2 / (n1 + n2) * squared distance of centroids."""
    c = centroids(points)
    a, b = (c.select(F.col("label").alias(f"l{s}"), F.col("n").alias(f"n{s}"), F.col("vec").alias(f"v{s}")) for s in "ab")
    sq = F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    cost = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * sq
    return a.join(b, F.col("la") < F.col("lb")).agg(F.min(cost).alias("cost"))


# ------------------------------------------------------------------ tests


def rank_genes(expr: DataFrame, groups: DataFrame, pvalues: bool = True) -> DataFrame:
    """One-vs-rest rank sums: expr(cell_id, gene, value >= 0), groups(cell_id, grp) ->
    grp, gene, score (z), logfc[, pval, pval_adj].

    Zeros stay implicit: a gene's zero block is n0 ties of mean rank (n0 + 1) / 2. Equal values
    are counted by group before they are ranked."""
    members = groups.select("cell_id", "grp").filter("grp IS NOT NULL")
    sizes = members.groupBy("grp").agg(F.count("*").alias("ng"))
    total = sizes.agg(F.sum("ng").alias("n"))
    vals = expr.filter("value > 0").join(members, "cell_id").groupBy("gene", "value", "grp").agg(F.count("*").alias("c"))
    at = vals.groupBy("gene", "value").agg(F.sum("c").alias("t"))
    upto = Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("gene")
    ranks = at.crossJoin(F.broadcast(total)).select("gene", "value", (F.col("n") - F.sum("t").over(every)).alias("n0"), (F.col("n") - F.sum("t").over(every) + F.sum("t").over(upto) - (F.col("t") - 1) / 2).alias("rank"))
    own = vals.join(ranks, ["gene", "value"]).groupBy("gene", "grp").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("nz"), F.sum(F.col("c") * F.col("value")).alias("s"))
    genes = ranks.groupBy("gene").agg(F.max("n0").alias("n0"))
    sums = own.groupBy("gene").agg(F.sum("s").alias("all"))
    grid = genes.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total)).join(own, ["gene", "grp"], "left").join(sums, "gene")
    n, ng = F.col("n"), F.col("ng")
    r = F.coalesce("r", F.lit(0.0)) + (ng - F.coalesce("nz", F.lit(0))) * (F.col("n0") + 1) / 2
    z = F.try_divide(r - ng * (n + 1) / 2, F.sqrt(ng.cast("double") * (n - ng) * (n + 1) / 12))
    s = F.coalesce("s", F.lit(0.0))
    m1, m2 = s / ng, F.try_divide(F.col("all") - s, (n - ng).cast("double"))
    out = grid.select("grp", "gene", z.alias("score"), F.log2((F.expm1(m1) + 1e-9) / (F.expm1(m2) + 1e-9)).alias("logfc"))
    if not pvalues:
        return out
    return bh_adjust(out.withColumn("pval", erfc(F.abs("score") / F.sqrt(F.lit(2.0)))), "grp")


def bh_adjust(df: DataFrame, by: str, p: str = "pval", new: str = "pval_adj") -> DataFrame:
    """Benjamini-Hochberg within `by`: the least p * n / rank of this and all greater p."""
    up = Window.partitionBy(by).orderBy(F.asc(p))
    down = Window.partitionBy(by).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    ranked = df.filter(F.col(p).isNotNull()).withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy(by)) / (F.rank().over(up) + F.count("*").over(Window.partitionBy(by, p)) - 1))
    return ranked.withColumn(new, F.least(F.lit(1.0), F.min("_q").over(down))).drop("_q")


def noise_filtered(deg: DataFrame, parent: DataFrame) -> DataFrame:
    """Keep genes that are up in the parent cluster too: parent(gene, parent_logfc)."""
    return deg.join(parent.select("gene", "parent_logfc"), "gene").filter("parent_logfc > 0")


def top_genes(deg: DataFrame, expr: DataFrame, groups: DataFrame, k: int = 6) -> DataFrame:
    """grp, gene, grp2, mean, fraction: the k best genes of each group in every group."""
    best = deg.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "gene"))).filter(F.col("r") <= k).select("gene").distinct()
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    sums = expr.join(best, "gene", "left_semi").join(groups, "cell_id").groupBy("gene", "grp").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    full = best.crossJoin(F.broadcast(sizes)).join(sums, ["gene", "grp"], "left")
    return full.select("gene", "grp", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("fraction"))


def welch(features: DataFrame, groups: DataFrame, first: str = "0", second: str = "1", pvalues: bool = True) -> DataFrame:
    """features(cell_id, ...numbers), groups(cell_id, grp) -> feature, t, df[, pval]."""
    names = [c for c in features.columns if c not in ("cell_id", "Cell_Type")]
    long = features.join(groups.filter(F.col("grp").isin(first, second)), "cell_id").select("grp", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("double") for c in names]))).alias("feature", "v"))
    m = long.groupBy("feature").agg(*[f(F.when(F.col("grp") == g, F.col("v"))).alias(f"{a}{i}") for i, g in ((1, first), (2, second)) for a, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    e1, e2 = F.try_divide(F.col("v1"), F.col("n1").cast("double")), F.try_divide(F.col("v2"), F.col("n2").cast("double"))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2))
    df = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1.0) + F.try_divide(e2 * e2, F.col("n2") - 1.0))
    out = m.select("feature", t.alias("t"), df.alias("df"))
    return out.withColumn("pval", t_two_sided("t", "df")) if pvalues else out


def merge_labels(cells: DataFrame, sub: DataFrame, drop_outliers: bool = True) -> DataFrame:
    """cells(cell_id, label), sub(cell_id, sub) -> cell_id, label, with '<label>_cluster<sub>'."""
    name = F.when(F.col("sub").isNull(), F.col("label")).otherwise(F.concat("label", F.lit("_cluster"), F.col("sub").cast("string")))
    out = cells.join(sub.select("cell_id", "sub"), "cell_id", "left").withColumn("label", name).drop("sub")
    return out.filter(~F.endswith("label", F.lit("_cluster-1"))) if drop_outliers else out


def frequent_neighbors(comp: DataFrame, least: float = 0.01, leave_out: tuple[str, ...] = ("Unassigned",)) -> DataFrame:
    """Labels whose mean share over all sources is at least `least`. comp(src, label, p) is sparse."""
    n = comp.agg(F.countDistinct("src").alias("n"))
    means = comp.groupBy("label").agg(F.sum("p").alias("s")).crossJoin(F.broadcast(n)).select("label", (F.col("s") / F.col("n")).alias("mean_p"))
    return means.filter((F.col("mean_p") >= least) & ~F.col("label").isin(*leave_out))


def rename_by_size(cells: DataFrame) -> DataFrame:
    """cells(cell_id, label) -> cell_id, label, name: C0 is the largest, ties by least cell."""
    sizes = cells.groupBy("label").agg(F.count("*").alias("n"), F.min("cell_id").alias("first"))
    names = sizes.withColumn("name", F.concat(F.lit("C"), F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1))
    names = save(names.select("label", "name"), "names")
    return cells.join(maybe_broadcast(names, names.count()), "label").select("cell_id", "label", "name")
