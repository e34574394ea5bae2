"""Spatial joins: radius joins, densities, and k nearest neighbours in the plane or of vectors.

A radius join keys asking points by grid cell and sends every target to the cells around its own,
with the exact predicate on what meets. The asking points of a crowded cell are dealt to several
blocks. For densities the points in and beside crowded cells are counted in groups: asking points that lie near
each other share bounds of their distance to a target, and only pairs that the radius may part are looked at.

k-NN is exact and takes two passes over parts of similar size, whose outlines are known to the
tasks: rectangles found by medians of a sample in the plane, balls around sampled pivots for vectors.
First each point meets its own part; its k-th distance then bounds the search, and it goes on to those parts only
whose outline lies within that distance. Parts with many targets or many asking points are dealt to
blocks. Vectors without clusters reach most balls, so in their second pass a point goes once to each group of balls, with
the list of those it is to meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..plans.storage import maybe_broadcast, save

#: Counted points up to which k-NN compares all with all.
FEW_POINTS = 4000
#: Points of a part at which k-NN aims; targets and asking points of one block at most, about.
PART, TARGETS, ASKING = 1024, 4096, 2048
#: Groups of balls of the second pass, at least if there are as many balls, and targets or asking points of one at most, about.
GROUPS, GROUP_POINTS = 12, 16_384
#: Parts that travel to tasks, at most: rectangles (32 bytes each) and pivots (vectors).
MOST_TILES, MOST_PIVOTS = 32_768, 2048
#: Sampled points a rectangle.
SAMPLED = 32
#: Asking points of a grid cell that share a block of a radius join, and places of a cell that are counted in groups if there are more.
BLOCK, CROWD = 2048, 1024
#: Asking points that share bounds of their distances, and those outside crowds that a task counts, about.
NEAR_POINTS, CALM_POINTS = 64, 256


# ---------------------------------------------------------------- radius


def _home(radius: float, x: str, y: str) -> dict[str, F.Column]:
    return {"hx": F.floor(F.col(x) / radius), "hy": F.floor(F.col(y) / radius)}


def _asking(left: DataFrame, radius: float) -> tuple[DataFrame, DataFrame, int]:
    """Asking points with their cell and block; the cells with several blocks, and how many there are."""
    a = left.select(F.col("cell_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumns(_home(radius, "ax", "ay"))
    crowds = save(a.groupBy("hx", "hy").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select("hx", "hy", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "crowds")
    n = crowds.count()
    if not n:
        return a.withColumn("block", F.lit(0)), crowds, n
    dealt = a.join(maybe_broadcast(crowds, n), ["hx", "hy"], "left")
    return dealt.withColumn("block", F.pmod(F.xxhash64("src"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks"), crowds, n


def _around(targets: DataFrame, crowds: DataFrame | None, n: int) -> DataFrame:
    """targets(hx, hy, ...), a row for each of the nine cells around and each of its blocks."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    out = targets.withColumn("step", step).withColumns({"hx": F.col("hx") + F.col("step.i"), "hy": F.col("hy") + F.col("step.j")}).drop("step")
    if not n:
        return out.withColumn("block", F.lit(0))
    out = out.join(maybe_broadcast(crowds, n), ["hx", "hy"], "left")
    return out.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")


def radius_join(left: DataFrame, right: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """left(cell_id, x, y), right alike -> src, dst, dist (rounded to digits, if given) of all pairs with dist <= radius."""
    kinds = [t.schema["cell_id"].dataType.simpleString() for t in (left, right)]

    def pairs(asking: pa.Table, targets: pa.Table):
        src, dst = taker(asking["cell_id"]), taker(targets["cell_id"])
        return lambda i, j, dist: [[src(i), dst(j), pa.array(rounded(dist, digits))]]

    return radius_rows(*(t.select("cell_id", "x", "y") for t in (left, right)), radius, pairs, f"src {kinds[0]}, dst {kinds[1]}, dist double")


#: Asking points and targets of one group of `radius_groups`, about; targets of one of `radius_rows`, whose time goes by the pair.
ASK_BLOCK, FEED, ROWS_FEED = 16_384, 65_536, 8192
#: Partitions of the groups, at most, and pairs that a task of `radius_rows` holds at a time.
GROUP_TASKS, PAIRS = 1024, 1 << 18


def _dealt(left: DataFrame, right: DataFrame, radius: float, feed: int) -> tuple[int, DataFrame, DataFrame, list[str]]:
    """left(cell_id, x, y, ...), right alike, with the keys of the groups in which they meet and the number of tasks. An asking point meets
    each target that may be within the radius in one group, and those of all its groups together."""
    cells, spots = ["hx", "hy"], ["sx", "sy"]
    # written, as cogrouped tables of one origin are ambiguous
    a, b = (save(t.withColumns(_home(radius, "x", "y")), "radius-points") for t in (left, right))
    around = _around(b.groupBy(cells).agg(F.count("*").alias("t")), None, 0).groupBy(cells).agg(F.sum("t").alias("t"))
    side = F.ceil(F.sqrt(F.col("c") / ASK_BLOCK)).cast("int")
    grid = save(a.groupBy(cells).agg(F.count("*").alias("c")).join(around, cells).select(*cells, side.alias("side"), F.ceil(F.col("t") / feed).cast("int").alias("parts")), "radius-cells")
    n = grid.count()
    deal = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, salt: F.pmod(F.xxhash64("cell_id", F.lit(salt)), F.col(c)).cast("int")
    # a crowded cell's asking points are dealt by place, those of a crowded place by their id
    spot = lambda c, h: F.least(F.floor((F.col(c) / radius - F.col(h)) * F.col("side")), F.col("side") - 1).cast("int")
    placed = a.join(maybe_broadcast(grid, n), cells).withColumns({"sx": spot("x", "hx"), "sy": spot("y", "hy")}).drop("side")
    crowds = save(placed.groupBy(*cells, *spots, "parts").agg(F.ceil(F.count("*") / ASK_BLOCK).cast("int").alias("blocks")), "radius-spots")
    m, groups = crowds.agg(F.count("*"), F.sum(F.col("blocks") * F.col("parts"))).first()
    tasks = max(1, min(GROUP_TASKS, groups or 1))
    asking = placed.drop("parts").join(maybe_broadcast(crowds, m), [*cells, *spots]).withColumn("block", own("blocks", 1)).withColumn("part", deal("parts")).drop("blocks", "parts")
    targets = _around(b, None, 0).drop("block").join(maybe_broadcast(crowds, m), cells).withColumn("block", deal("blocks")).withColumn("part", own("parts", 2)).drop("blocks", "parts")
    keys = [*cells, *spots, "block", "part"]
    return tasks, asking, targets, keys


def radius_groups(left: DataFrame, right: DataFrame, radius: float, work, schema: str) -> DataFrame:
    """left(cell_id, x, y, ...), right alike: what work(asking, targets) returns for a block of the
    asking points of a grid cell, which lie near each other, and a part of the targets of the nine cells
    around, as Arrow tables. No pair leaves its task."""
    tasks, asking, targets, keys = _dealt(left, right, radius, FEED)
    return asking.repartition(tasks, *keys).groupBy(*keys).cogroup(targets.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(work, schema)


def _flat(column: pa.StructArray) -> pa.Table:
    """The structs that are not null, by field."""
    column = column.filter(column.is_valid())
    return pa.Table.from_arrays(column.flatten(), names=[f.name for f in column.type])


def taker(column: pa.ChunkedArray):
    """A function that gives the column's values at places."""
    held = column.combine_chunks()
    if pa.types.is_integer(held.type) and not held.null_count:
        values = held.to_numpy()
        return lambda at: pa.array(values[at])
    return lambda at: held.take(pa.array(at))


def within(asking: pa.Table, targets: pa.Table, radius: float):
    """asking rows and targets within the radius by their places, with their distances, some at a time."""
    ax, ay, bx, by = (t[c].to_numpy().astype(float) for t in (asking, targets) for c in ("x", "y"))
    for own in _tiles(ax, ay, NEAR_POINTS) if len(ax) and len(bx) else []:
        some = np.flatnonzero(_reach(ax[own], ay[own], bx, by)[0] <= radius * (1 + 1e-9))
        for at in range(0, len(some), PAIRS // NEAR_POINTS):
            part = some[at : at + PAIRS // NEAR_POINTS]
            dx, dy = ax[own, None] - bx[None, part], ay[own, None] - by[None, part]
            d = np.sqrt(dx * dx + dy * dy)
            i, j = np.nonzero(d <= radius)
            yield own[i], part[j], d[i, j]


def radius_rows(left: DataFrame, right: DataFrame, radius: float, rows, schema: str) -> DataFrame:
    """left(cell_id, x, y, ...), right alike: what rows(asking, targets) makes of a group, a function of some pairs within the
    radius at a time (i, j, dist) that gives lists of columns. Points are shuffled, pairs never; a task holds one group's
    points and at most PAIRS pairs, however many rows it returns."""
    left, right = (t.filter(F.expr("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")) for t in (left, right))
    tasks, asking, targets, keys = _dealt(left, right, radius, ROWS_FEED)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches).combine_chunks()
        a, b = (_flat(both[c].combine_chunks()) for c in ("asking", "target"))
        made = rows(a, b)
        for i, j, dist in within(a, b, radius):
            for columns in made(i, j, dist) if len(i) else []:
                yield pa.RecordBatch.from_arrays(columns, names)

    packed = lambda t, of: F.struct(*[c for c in of.columns if c not in keys]).alias(t)
    no = lambda t, of: F.lit(None).cast(of.select(packed(t, of)).schema[t].dataType).alias(t)
    a, b = asking.select(*keys, packed("asking", asking), no("target", targets)), targets.select(*keys, no("asking", asking), packed("target", targets))
    return a.unionAll(b).repartition(tasks, *keys).groupBy(*keys).applyInArrow(run, schema)


def _tiles(x: np.ndarray, y: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of points that lie near each other, at most `most` in each."""
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            done.append(own)
            continue
        along = x[own] if np.ptp(x[own]) >= np.ptp(y[own]) else y[own]
        order = own[np.argsort(along, kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def _reach(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each target's distance to any of the points (x, y), a little wide."""
    x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
    gx, gy = np.maximum(np.maximum(x0 - bx, bx - x1), 0), np.maximum(np.maximum(y0 - by, by - y1), 0)
    fx, fy = np.maximum(bx - x0, x1 - bx), np.maximum(by - y0, y1 - by)
    return np.sqrt(gx * gx + gy * gy) * (1 - 1e-9), np.sqrt(fx * fx + fy * fy) * (1 + 1e-9)


def _counted(radius: float, kind: pa.DataType):
    """In tasks, of a block of asking points and a part of the targets around: src, n of the targets within the radius.

    Asking points that lie near each other share bounds of their distance to a target, so that a pair is only
    looked at where the radius lies between them."""

    def run(asking: pa.Table, targets: pa.Table) -> pa.Table:
        ax, ay, bx, by = (t.column(c).to_numpy().astype(float) for t in (asking, targets) for c in ("x", "y"))
        weight, found = targets.column("n").to_numpy().astype(np.int64), np.zeros(len(ax), np.int64)
        for own in _tiles(ax, ay, NEAR_POINTS) if len(bx) else []:
            near, far = _reach(ax[own], ay[own], bx, by)
            whole = far <= radius * (1 - 1e-9)
            some = np.flatnonzero((near <= radius * (1 + 1e-9)) & ~whole)
            found[own] = weight[whole].sum()
            for at in range(0, len(some), PAIRS // NEAR_POINTS):
                part = some[at : at + PAIRS // NEAR_POINTS]
                dx, dy = ax[own, None] - bx[None, part], ay[own, None] - by[None, part]
                found[own] += (np.sqrt(dx * dx + dy * dy) <= radius) @ weight[part]
        return pa.table({"src": asking.column("cell_id").cast(kind), "n": pa.array(found)})

    return run


def density(points: DataFrame, radius: float, crowd: int = CROWD) -> DataFrame:
    """cell_id, density: points within the radius, itself included. Points of one coordinate are
    merged with their count first; around cells of more than `crowd` places they are counted in groups."""
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id"))
    known = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
    places = save(places.filter(known).withColumns(_home(radius, "x", "y")), "places")
    crowded = save(places.groupBy("hx", "hy").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("hx", "hy"), "crowded")
    near = _crowded_density(places, crowded, radius) if crowded.count() else _plain_density(places, places, radius)
    return points.select("cell_id", "x", "y").join(places.select("x", "y", F.col("cell_id").alias("src")), ["x", "y"]).join(near, "src").select("cell_id", "density")


def _plain_density(asking: DataFrame, places: DataFrame, radius: float, tasks: int | None = None) -> DataFrame:
    a, crowds, n = _asking(asking, radius)
    b = _around(places.select(F.col("x").alias("bx"), F.col("y").alias("by"), "n", "hx", "hy"), crowds, n)
    if tasks:  # few bytes may hold many pairs, so bytes are not to set the number of tasks
        a, b = (t.repartition(tasks, "hx", "hy", "block") for t in (a, b))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = a.join(b, ["hx", "hy", "block"]).filter(F.sqrt(dx * dx + dy * dy) <= radius)
    return met.groupBy("src").agg(F.sum("n").alias("density"))


def _crowded_density(places: DataFrame, crowded: DataFrame, radius: float) -> DataFrame:
    """Places in and beside crowded cells are counted by tasks without pairs, the others by a join."""
    busy = save(_around(crowded, None, 0).select("hx", "hy").distinct(), "busy")
    busy = maybe_broadcast(busy, busy.count())
    field = places.schema["cell_id"].dataType.simpleString()
    kind = pa.int64() if field == "bigint" else pa.int32() if field == "int" else pa.string()
    asking = places.join(busy, ["hx", "hy"], "left_semi").select("cell_id", "x", "y")
    counted = radius_groups(asking, places.select("cell_id", "x", "y", "n"), radius, _counted(radius, kind), f"src {field}, n long")
    rest = places.join(busy, ["hx", "hy"], "left_anti")
    calm = _plain_density(rest, places, radius, 1 + min(GROUP_TASKS - 1, rest.count() // CALM_POINTS))
    return counted.groupBy("src").agg(F.sum("n").alias("density")).unionByName(calm)


# ---------------------------------------------------------------- k nearest


class Tiles:
    """Rectangles that share out the plane, found by medians of a sample."""

    def __init__(self, sample: np.ndarray, n: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, below, above; leaves are ~number
        self.boxes: list[np.ndarray] = []
        self.root = self._grow(sample, max(1, min(n, len(sample))), np.array([[-np.inf, np.inf]] * 2))
        self.boxes = np.array(self.boxes)

    def _grow(self, points: np.ndarray, parts: int, box: np.ndarray) -> int:
        if parts > 1:
            for axis in np.argsort(-np.ptp(points, 0), kind="stable").tolist():
                values = np.sort(points[:, axis])
                if values[0] < values[-1]:
                    cut = values[len(values) // 2]
                    cut = cut if cut > values[0] else values[values > values[0]][0]
                    below, low, high = points[:, axis] < cut, box.copy(), box.copy()
                    low[axis, 1] = high[axis, 0] = cut
                    own = len(self.nodes)
                    self.nodes.append((axis, float(cut), 0, 0))
                    share = min(parts - 1, max(1, round(parts * below.mean())))
                    self.nodes[own] = (axis, float(cut), self._grow(points[below], share, low), self._grow(points[~below], parts - share, high))
                    return own
        self.boxes.append(box)
        return -len(self.boxes)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(v), self.root)
        if self.nodes:
            axis, cut, low, high = (np.array(c) for c in zip(*self.nodes, strict=True))
            while len(inner := np.flatnonzero(at >= 0)):
                k = at[inner]
                at[inner] = np.where(v[inner, axis[k]] < cut[k], low[k], high[k])
        return -at - 1, np.zeros(len(v))

    def visits(self, v: np.ndarray, part: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of v and the other rectangles that may hold something as near as theta."""
        own = self.boxes[part]
        margin = np.minimum(v - own[:, :, 0], own[:, :, 1] - v).min(1)
        crossing, out = np.flatnonzero(theta >= margin), []
        for a in range(0, len(crossing), 256):
            rows = crossing[a : a + 256]
            gap = np.maximum(np.maximum(self.boxes[None, :, :, 0] - v[rows, None], v[rows, None] - self.boxes[None, :, :, 1]), 0)
            near = np.sqrt((gap * gap).sum(2)) <= theta[rows, None]
            near[np.arange(len(rows)), part[rows]] = False
            i, j = np.nonzero(near)
            out.append((rows[i], j))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (crossing, crossing)


class Balls:
    """Sampled pivots; a vector belongs to the nearest. The triangle inequality bounds how near a
    ball's vectors can be: by the distances to its pivot, and to the plane between two pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.least, self.most = pivots, np.zeros(len(pivots)), np.full(len(pivots), np.inf)

    def __getstate__(self) -> dict:
        return {c: x for c, x in self.__dict__.items() if c != "between"}

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of all pivots, found by each worker for itself."""
        return self._distances(self.pivots)

    def kept(self, which: np.ndarray) -> Balls:
        return Balls(self.pivots[which])

    def ordered(self) -> Balls:
        """The same balls along the direction in which the pivots vary most."""
        away = self.pivots - self.pivots.mean(0)
        return self.kept(np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable"))

    def _distances(self, v: np.ndarray) -> np.ndarray:
        center = self.pivots.mean(0)
        a, b = v - center, self.pivots - center
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(v)
        part = d.argmin(1)
        return part, d[np.arange(len(v)), part]

    def visits(self, v: np.ndarray, part: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(v)
        own = d[np.arange(len(v)), part]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((d * d - (own * own)[:, None]) / (2 * self.between[part]), nan=0.0, posinf=0.0)
        bound = np.maximum(np.maximum(d - self.most, self.least - d), plane)
        # distances by products are a little rough
        slack = 1e-6 * (np.abs(v).max() + np.abs(self.pivots).max()) if len(v) else 0.0
        near = bound <= theta[:, None] + slack
        near[np.arange(len(v)), part] = False
        return np.nonzero(near)


#: Rectangles of kth_distances at most; each aims at a fourth of k points. Distances that a task holds at a time.
KTH_TILES, SLAB = 512, 1 << 20


def _kth(k: int, kind: pa.DataType):
    schema = pa.schema([("cell_id", kind), ("dist", pa.float64())])

    def run(asking: pa.Table, targets: pa.Table) -> pa.Table:
        ax, ay, bx, by = (t.column(c).to_numpy() for t in (asking, targets) for c in ("x", "y"))
        found, step = [np.zeros(0)], max(1, SLAB // max(1, len(bx)))
        for at in range(0, len(ax) if len(bx) > k else 0, step):
            dx, dy = ax[at : at + step, None] - bx, ay[at : at + step, None] - by
            found.append(np.partition(np.sqrt(dx * dx + dy * dy), k, 1)[:, k])  # itself is among them
        found = np.concatenate(found)
        return pa.Table.from_arrays([asking.column("cell_id").slice(0, len(found)), pa.array(found)], schema=schema)

    return run


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """cell_id, dist to the k-th nearest other point of points(cell_id, x, y), without any other neighbour.

    A rectangle's points all have k others within the least distance that holds the farthest corners of so many,
    so its points meet those rectangles only that come so near, in one task for a block of them."""
    p = save(points.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x = x AND y = y AND NOT isnan(x) AND NOT isnan(y)"), "kth-points")
    n, kind = p.count(), p.schema["cell_id"].dataType.simpleString()
    if n <= k:
        return p.select("cell_id", F.lit(0.0).alias("dist")).limit(0)
    count = max(1, min(KTH_TILES, 4 * n // k))
    sample = p.orderBy(F.xxhash64("cell_id"), "cell_id").limit(SAMPLED * count).select("x", "y").toPandas().to_numpy(float)
    tiles = Tiles(sample, count)

    def assign(batches):
        for b in batches:
            yield b.assign(tile=tiles.assign(b[["x", "y"]].to_numpy(float))[0].astype(np.int32))

    held = save(p.mapInPandas(assign, f"cell_id {kind}, x double, y double, tile int"), "kth-tiles")
    box = held.groupBy("tile").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]).toPandas()
    lo, hi, sizes = box[["x0", "y0"]].to_numpy(float), box[["x1", "y1"]].to_numpy(float), box["n"].to_numpy()
    far = np.sqrt((np.maximum(hi[:, None] - lo[None], hi[None] - lo[:, None]) ** 2).sum(-1))
    gap = np.sqrt((np.maximum(np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]), 0) ** 2).sum(-1))
    meets = []
    for i, tile in enumerate(box["tile"].tolist()):
        order = np.argsort(far[i], kind="stable")
        reach = far[i, order[np.searchsorted(np.cumsum(sizes[order]), k + 1)]]
        meets += [(int(box["tile"][j]), tile, -(-int(sizes[i]) // ASKING)) for j in np.flatnonzero(gap[i] <= reach * (1 + 1e-9))]
    plan = p.sparkSession.createDataFrame(meets, "tile int, asks int, blocks int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = held.join(F.broadcast(plan.select("asks", "blocks").distinct().withColumnRenamed("asks", "tile")), "tile")
    asking = asking.select("cell_id", "x", "y", F.col("tile").alias("asks"), F.pmod(F.xxhash64("cell_id"), "blocks").cast("int").alias("block"))
    # of columns by other names, as cogrouped tables of one origin are ambiguous
    targets = held.select(F.col("tile").alias("own"), F.col("x").alias("tx"), F.col("y").alias("ty")).join(F.broadcast(plan), F.col("own") == F.col("tile")).select(F.col("tx").alias("x"), F.col("ty").alias("y"), "asks", "blocks")
    targets = targets.select("x", "y", "asks", every.alias("block"))
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return asking.groupBy("asks", "block").cogroup(targets.groupBy("asks", "block")).applyInArrow(_kth(k, arrow), f"cell_id {kind}, dist double")


def _nearest(k: int):
    def run(both: pd.DataFrame) -> pd.DataFrame:
        left, right = both[both["asks"]], both[~both["asks"]].sort_values("id")
        out = [pd.DataFrame({"src": left["id"][:0], "dst": right["id"][:0], "dist": np.zeros(0)})]
        if len(left) and len(right):
            ids, m = right["id"].to_numpy(), np.stack(right["vec"].to_numpy()).astype(float)
            center = m.mean(0)
            own_m = m - center
            squares_m = (own_m * own_m).sum(1)
            last = min(k, len(ids) - 1)  # one more than k, as a point may find itself
            for a in range(0, len(left), 512):
                part = left.iloc[a : a + 512]
                v = np.stack(part["vec"].to_numpy()).astype(float)
                own_v = v - center
                squares = (own_v * own_v).sum(1)[:, None] + squares_m[None]
                # one matrix product finds who may be near; their distances are then taken exactly
                rough = squares - 2 * (own_v @ own_m.T)
                i, j = np.nonzero(rough <= np.partition(rough, last, 1)[:, last, None] + 1e-9 * squares.max(1, keepdims=True))
                away = v[i] - m[j]
                d, own = np.sqrt((away * away).sum(1)), part["id"].to_numpy()[i]
                order = np.lexsort((j, d, i))
                order = order[ids[j[order]] != own[order]]
                starts = np.searchsorted(i[order], i[order], "left")
                order = order[np.arange(len(order)) - starts < k]
                out.append(pd.DataFrame({"src": own[order], "dst": ids[j[order]], "dist": d[order]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return run


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in chunks]).reshape(len(column), -1)


def _visited(k: int, kind: pa.DataType):
    """Of asking rows (id, vec, theta, visits) and a group's targets (id, vec, part): src, dst, dist, the k nearest of
    each, among the parts that it visits and within theta."""
    schema = pa.schema([("src", kind), ("dst", kind), ("dist", pa.float64())])

    def best(i: np.ndarray, j: np.ndarray, d: np.ndarray, place: np.ndarray) -> np.ndarray:
        order = np.lexsort((place[j], d, i))
        return order[np.arange(len(order)) - np.searchsorted(i[order], i[order], "left") < k]

    def run(both: pa.Table) -> pa.Table:
        left, right = both.filter(both["asks"]), both.filter(pc.invert(both["asks"])).sort_by([("part", "ascending")])
        if not len(left) or not len(right):
            return schema.empty_table()
        asking, asked = left["id"].combine_chunks(), right["id"].combine_chunks()
        place = np.empty(len(asked), int)
        place[np.argsort(asked.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(asked))  # ties go by id
        m, thetas = _vectors(right["vec"]), left["theta"].to_numpy()
        center = m.mean(0)
        own_m = m - center
        squares_m = (own_m * own_m).sum(1)
        parts, first = np.unique(right["part"].to_numpy(), return_index=True)
        ends, made = [*first[1:].tolist(), len(m)], [schema.empty_table()]
        for at in range(0, len(left), 512):
            rows = left.slice(at, 512)
            v, lists = _vectors(rows["vec"]), rows["visits"].combine_chunks()
            own_v = v - center
            squares = (own_v * own_v).sum(1)
            who, which = np.repeat(np.arange(len(v)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            order = np.argsort(which, kind="stable")
            who, which = who[order], which[order]
            limit = thetas[at : at + len(v)] ** 2 * (1 + 1e-9)
            i, j, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for part, a, b in zip(parts.tolist(), first.tolist(), ends, strict=True):
                some = who[np.searchsorted(which, part) : np.searchsorted(which, part, "right")]
                if not len(some):
                    continue
                # one matrix product finds who may be near; their distances are then taken exactly
                rough = squares[some, None] + squares_m[None, a:b] - 2 * (own_v[some] @ own_m[a:b].T)
                slack = 1e-9 * (squares[some] + squares_m[a:b].max())
                r, c = np.nonzero(rough <= (limit[some] + slack)[:, None])
                if len(r) > 16 * k * len(some) and b - a > k:
                    limit[some] = np.minimum(limit[some], np.partition(rough, k - 1, 1)[:, k - 1] + slack)
                    r, c = np.nonzero(rough <= (limit[some] + slack)[:, None])
                r, c = some[r], c + a
                found = np.concatenate([np.sqrt(((v[r[x : x + 65536]] - m[c[x : x + 65536]]) ** 2).sum(1)) for x in range(0, len(r), 65536)] or [d[:0]])
                i, j, d = np.concatenate([i, r]), np.concatenate([j, c]), np.concatenate([d, found])
                if len(i) > 4 * k * len(v):
                    keep = best(i, j, d, place)
                    i, j, d = i[keep], j[keep], d[keep]
                    full = np.flatnonzero(np.diff(i, append=-1))  # the last, and so the farthest, of each row
                    full = full[np.bincount(i, minlength=len(v))[i[full]] == k]
                    limit[i[full]] = np.minimum(limit[i[full]], d[full] ** 2 * (1 + 1e-9))
            keep = best(i, j, d, place)
            made.append(pa.Table.from_arrays([asking.take(pa.array(at + i[keep])), asked.take(pa.array(j[keep])), pa.array(d[keep])], schema=schema))
        return pa.concat_tables(made)

    return run


def _grouped_visits(parts: Balls, group: np.ndarray, counted: bool):
    """bounded rows, each once for every group of balls it visits, with the list of these balls; or how many
    visit a ball, and a group g (as part -1 - g). Balls are in order of their groups."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                theta = rows.column("theta").to_numpy(zero_copy_only=False)
                i, j = parts.visits(_vectors(rows.column("vec")), rows.column("part").to_numpy(), theta)
                g = group[j]
                starts = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(g, prepend=-1) != 0))
                if counted:
                    part, n = np.unique(np.concatenate([j, -1 - g[starts]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int64())], ["part", "n"])
                elif len(starts):
                    take = pa.array(i[starts])
                    lists = pa.ListArray.from_arrays(pa.array([*starts, len(j)], pa.int32()), pa.array(j, pa.int32()))
                    yield pa.RecordBatch.from_arrays([rows.column("id").take(take), rows.column("vec").take(take), pa.array(theta[i[starts]]), pa.array(g[starts], pa.int32()), lists], ["id", "vec", "theta", "grp", "visits"])

    return run


def _met_groups(bounded: DataFrame, targets: DataFrame, balls: Balls, group: np.ndarray, asked: dict[int, int], sizes: dict[int, int], k: int) -> DataFrame:
    """src, dst, dist: k a block, of the balls that bounded rows visit. A row is shuffled once a group and block
    of targets, a target once a group's block of asking rows: n * n / GROUP_POINTS rows of either if all meet."""
    spark, kind = bounded.sparkSession, bounded.schema["id"].dataType.simpleString()
    held = np.bincount(group, [sizes.get(p, 0) for p in range(len(group))])
    plan = F.broadcast(spark.createDataFrame([(g, -(-n // GROUP_POINTS), max(1, -(-int(held[g]) // GROUP_POINTS))) for g, n in asked.items()], "grp int, salts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    visiting = bounded.mapInArrow(_grouped_visits(balls, group, False), f"id {kind}, vec array<double>, theta double, grp int, visits array<int>")
    a = visiting.join(plan, "grp").select("id", "vec", F.lit(True).alias("asks"), F.lit(0).alias("part"), "theta", "visits", "grp", own("salts").alias("salt"), every("blocks").alias("block"))
    of = F.get(F.array(*map(F.lit, group.tolist())), F.col("part"))
    t = targets.withColumn("grp", of).join(plan, "grp").select("id", "vec", F.lit(False).alias("asks"), "part", F.lit(None).cast("double").alias("theta"), F.lit(None).cast("array<int>").alias("visits"), "grp", every("salts").alias("salt"), own("blocks").alias("block"))
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return a.unionAll(t).groupBy("grp", "salt", "block").applyInArrow(_visited(k, arrow), f"src {kind}, dst {kind}, dist double")


def _met(asking: DataFrame, targets: DataFrame, asked: dict[int, int], sizes: dict[int, int], k: int) -> DataFrame:
    """asking(id, vec, part), targets alike -> src, dst, dist: k a block, of the parts asked for."""
    spark = asking.sparkSession
    rows = [(p, -(-n // ASKING), max(1, -(-sizes.get(p, 0) // TARGETS))) for p, n in asked.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "part int, salts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = asking.join(plan, "part").select("id", "vec", F.lit(True).alias("asks"), "part", own("salts").alias("salt"), every("blocks").alias("block"))
    t = targets.join(plan, "part").select("id", "vec", F.lit(False).alias("asks"), "part", every("salts").alias("salt"), own("blocks").alias("block"))
    kind = asking.schema["id"].dataType.simpleString()
    return a.unionAll(t).groupBy("part", "salt", "block").applyInPandas(_nearest(k), f"src {kind}, dst {kind}, dist double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("src").orderBy("dist", "dst")
    return near.select("src", "dst", F.row_number().over(best).alias("rank"), "dist").filter(F.col("rank") <= k)


def _assigned(parts, kind: str):
    def run(batches):
        for batch in batches:
            if len(batch):
                part, own = parts.assign(np.stack(batch["vec"].to_numpy()).astype(float))
                yield batch.assign(part=part.astype(np.int32), own=own)

    return run, f"id {kind}, vec array<double>, part int, own double"


def _visits(parts, counted: bool):
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 1024):
                rows = batch.iloc[a : a + 1024]
                i, j = parts.visits(np.stack(rows["vec"].to_numpy()).astype(float), rows["part"].to_numpy(), rows["theta"].to_numpy(float))
                if counted:
                    part, n = np.unique(j, return_counts=True)
                    yield pd.DataFrame({"part": part.astype(np.int32), "n": n})
                else:
                    # one column after another: a point may go to many parts
                    for s in range(0, len(i), 4096):
                        own = rows.iloc[i[s : s + 4096]]
                        yield pd.DataFrame({"id": own["id"].to_numpy(), "vec": own["vec"].to_numpy(), "part": j[s : s + 4096].astype(np.int32)})

    return run


def _in_parts(rows: DataFrame, k: int, parts, report: dict | None) -> DataFrame:
    """rows(id, vec) -> src, dst, rank, dist, by two passes over the parts."""
    kind = rows.schema["id"].dataType.simpleString()
    run, schema = _assigned(parts, kind)
    held = save(rows.mapInPandas(run, schema), "knn-parts")
    # of equal vectors only the k + 1 least ids can be anyone's neighbours
    least = F.row_number().over(Window.partitionBy("part", "vec").orderBy("id"))
    targets = save(held.withColumn("r", least).filter(F.col("r") <= k + 1).drop("r"), "knn-targets")
    asked = {r[0]: r[1] for r in held.groupBy("part").count().collect()}  # one row a part
    known = {r[0]: tuple(r)[1:] for r in targets.groupBy("part").agg(F.count("*"), F.min("own"), F.max("own")).collect()}
    sizes = {p: x[0] for p, x in known.items()}
    if isinstance(parts, Balls):
        for p in range(len(parts.pivots)):
            parts.least[p], parts.most[p] = known[p][1:] if p in known else (np.inf, -np.inf)
    near = save(_ranked(_met(held, targets, asked, sizes, k), k), "knn-own")
    theta = near.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") == k, F.max("dist")).alias("theta"))
    bounded = save(held.select("id", "vec", "part").join(theta, "id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("inf")))), "knn-bounds")
    counts = "part int, n long"
    if isinstance(parts, Balls):
        weight = np.array([sizes.get(p, 0) for p in range(len(parts.pivots))])
        count = max(1, min(len(weight), max(GROUPS, -(-int(weight.sum()) // GROUP_POINTS))))
        group = (np.cumsum(weight) - weight) * count // max(1, weight.sum())
        visited = bounded.mapInArrow(_grouped_visits(parts, group, True), counts)
    else:
        visited = bounded.mapInPandas(_visits(parts, True), counts)
    found = {r[0]: r[1] for r in visited.groupBy("part").agg(F.sum("n")).collect()}
    more = {p: n for p, n in found.items() if p >= 0}
    if report is not None:
        report.update(parts=len(known), own=sum(n * sizes[p] for p, n in asked.items()), visits=sum(more.values()), others=sum(n * sizes.get(p, 0) for p, n in more.items()))
    if not more:
        return near
    if isinstance(parts, Balls):
        others = _met_groups(bounded, targets, parts, group, {-1 - p: n for p, n in found.items() if p < 0}, sizes, k)
    else:
        others = _met(bounded.mapInPandas(_visits(parts, False), f"id {kind}, vec array<double>, part int"), targets, more, sizes, k)
    return _ranked(near.select("src", "dst", "dist").unionByName(others), k)


def _sampled(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """About `most` vectors, chosen by a hash of their ids; never more than twice as many."""
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
    got = rows.filter(share).select("vec").limit(2 * most).toPandas()["vec"]
    return np.stack(got.to_numpy()).astype(float) if len(got) else np.zeros((0, 2))


def knn(points: DataFrame, k: int, few: int = FEW_POINTS, report: dict | None = None) -> DataFrame:
    """src, dst, rank (1..k), dist: the k nearest other points, ties by id. Self is excluded by id,
    so points at one place are neighbours of each other. Up to `few` points are compared with all.
    Points without both coordinates are no one's neighbours. report gets the pairs compared."""
    placed = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n = placed.count()
    if n <= few:  # one small pass beats two over parts
        a = placed.select(F.col("cell_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = placed.select(F.col("cell_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        near = a.join(F.broadcast(b), F.col("src") != F.col("dst")).withColumn("dist", F.sqrt(dx * dx + dy * dy))
        return _ranked(near, k)
    rows = placed.select(F.col("cell_id").alias("id"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("vec"))
    tiles = max(1, min(MOST_TILES, n // PART))
    return _in_parts(rows, k, Tiles(_sampled(rows, n, SAMPLED * tiles), tiles), report)


def knn_vectors(points: DataFrame, k: int, few: int = FEW_POINTS, report: dict | None = None) -> DataFrame:
    """Exact k-NN of vectors: src, dst, rank, dist, like knn. Pivots whose balls hold fewer than
    2 (k + 1) vectors give them to others, so that a first pass finds k for most."""
    rows = points.filter("vec IS NOT NULL").select(F.col("cell_id").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    n = rows.count()
    if n <= few:
        return _in_parts(rows, k, Balls(np.zeros((1, rows.select(F.max(F.size("vec"))).first()[0] or 1))), report)
    balls = Balls(np.unique(_sampled(rows, n, min(MOST_PIVOTS, int(2 * n**0.5))), axis=0))
    if len(balls.pivots) > 1:
        kind = rows.schema["id"].dataType.simpleString()
        run, schema = _assigned(balls, kind)
        sizes = {r[0]: r[1] for r in rows.mapInPandas(run, schema).groupBy("part").count().collect()}
        large = np.array([p for p in range(len(balls.pivots)) if sizes.get(p, 0) >= 2 * (k + 1)], np.int64)
        balls = (balls.kept(large) if len(large) else balls).ordered()
    return _in_parts(rows, k, balls, report)
