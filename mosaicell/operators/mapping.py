"""From scales to distances: density groups, Poisson-disk seeds, impulse responses, heatmaps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..plans.storage import save
from ..sources.tables import write_mapping
from .neighbors import GROUP_TASKS, _reach, _tiles, density, radius_groups, radius_join, radius_rows, taker, within
from .spectral import MAPPING_SCALES, heat_filter

# ------------------------------------------------------------------ density groups


def density_groups(cells: DataFrame, column: str = "density", percentile: float = 10, new: str = "density_group") -> DataFrame:
    """cells with Low, Medium or High by the outer percentiles (exact, interpolated), high first."""
    q = cells.agg(F.percentile(column, percentile / 100).alias("q_low"), F.percentile(column, 1 - percentile / 100).alias("q_high"))
    group = F.when(F.col(column) >= F.col("q_high"), "High").when(F.col(column) <= F.col("q_low"), "Low").otherwise("Medium")
    return cells.crossJoin(F.broadcast(q)).withColumn(new, group)


# ------------------------------------------------------------------ sampling


def sampling_priority(points: DataFrame, order: str = "random", seed: int = 0, given: str | None = None) -> DataFrame:
    """points with a unique `priority`, the smaller the earlier."""
    if order == "random":
        key = F.struct(F.xxhash64(F.lit(seed), F.col("cell_id")), F.col("cell_id"))
    elif order == "raster":
        key = F.struct(F.col("x"), F.col("y"), F.col("cell_id"))
    elif order == "given" and given:
        key = F.struct(F.col(given), F.col("cell_id"))
    else:
        raise ValueError("order must be 'random', 'raster' or 'given' with a column")
    return points.withColumn("priority", key)


#: Points that one task picks from one after the other, about a second's work.
SERIAL_POINTS = 100_000


def _serial_picks(r: float, side: float):
    """The greedy pick of rows that come in order; a cell holds one pick at most."""

    def run(batches):
        held: dict[tuple[int, int], tuple[float, float]] = {}
        for batch in batches:
            kept = []
            for x, y in zip(batch["x"].tolist(), batch["y"].tolist(), strict=True):
                gx, gy = math.floor(x / side), math.floor(y / side)
                near = (held.get((gx + i, gy + j)) for i in range(-2, 3) for j in range(-2, 3))
                free = all(p is None or math.sqrt((x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1])) >= r for p in near)
                if free:
                    held[gx, gy] = (x, y)
                kept.append(free)
            yield batch.loc[kept, ["cell_id"]]

    return run


def poisson_disk(points: DataFrame, r: float, order: str = "random", seed: int = 0, given: str | None = None, target_n: int | None = None, serial: int = SERIAL_POINTS) -> DataFrame:
    """cell_id, priority of points picked greedily in order, none nearer than r to another.

    Up to SERIAL_POINTS points are scanned in one task. The greedy pick of more needs no serial scan
    and no pairs of points. Cells of side r / sqrt(2) hold one
    pick at most, and what lies within r of a point lies within two cells. In each round the first
    point of each cell is picked if it comes before the first of all 5 x 5 cells around, and what is
    nearer than r to a pick leaves."""
    if target_n is not None and target_n > 0 and r > 0:
        return _first_picks(points, r, order, seed, given, target_n, serial)
    if target_n is not None or r <= 0:
        every = sampling_priority(points, order, seed, given).select("cell_id", "priority")
        return every if target_n is None else every.orderBy("priority").limit(max(0, target_n))
    side = r / 2**0.5
    key = [F.floor(F.col(c) / side).alias(g) for c, g in (("x", "gx"), ("y", "gy"))]
    todo = save(sampling_priority(points, order, seed, given).select("cell_id", "x", "y", "priority", *key), "disk")
    if todo.count() <= serial:
        kind = points.schema["cell_id"].dataType.simpleString()
        rows = todo.select("cell_id", "x", "y", "priority").coalesce(1).sortWithinPartitions("priority").drop("priority")
        picks = rows.mapInPandas(_serial_picks(r, side), f"cell_id {kind}")
        return save(todo.select("cell_id", "priority").join(picks, "cell_id"), "disk-picked")
    around = lambda df: df.withColumn("gx", F.explode(F.sequence(F.col("gx") - 2, F.col("gx") + 2))).withColumn("gy", F.explode(F.sequence(F.col("gy") - 2, F.col("gy") + 2)))
    picked = None
    while True:
        firsts = todo.groupBy("gx", "gy").agg(F.min(F.struct("priority", "cell_id", "x", "y")).alias("p")).select("gx", "gy", "p.*")
        best = around(firsts.select("gx", "gy", "priority")).groupBy("gx", "gy").agg(F.min("priority").alias("best"))
        now = save(firsts.join(best, ["gx", "gy"]).filter("priority = best").drop("best"), "disk-picked")
        picked = now if picked is None else picked.unionByName(now)
        shade = around(now.select("gx", "gy", F.col("x").alias("px"), F.col("y").alias("py"))).withColumnsRenamed({"gx": "hx", "gy": "hy"})
        dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
        near = (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy")) & (F.sqrt(dx * dx + dy * dy) < r)
        todo = save(todo.join(shade, near, "left_anti"), "disk")
        if not todo.limit(1).count():
            break
    return picked.select("cell_id", "priority")


#: Points looked at first for each that is to be picked; four times as many after each try that holds too few.
LOOK_AHEAD = 4


def _first_picks(points: DataFrame, r: float, order: str, seed: int, given: str | None, target_n: int, serial: int) -> DataFrame:
    """The first target_n picks. What is picked of the first points in order does not depend on later
    ones, so only as many are looked at as it takes."""
    ranked = sampling_priority(points, order, seed, given)
    look = LOOK_AHEAD * target_n
    while True:
        some = save(ranked.orderBy("priority").limit(look), "disk-first")
        picked = poisson_disk(some.drop("priority"), r, order, seed, given, None, serial)
        found, whole = picked.count(), some.count() < look
        if found >= target_n or whole:
            return picked.orderBy("priority").limit(target_n)
        look *= 4


def sample_rounds(points: DataFrame, r: float = 500, target_total: int = 500, seed: int = 0, first_round_n: int = 200, first_round_candidates: int = 200_000, per_round: int | None = None, preferred: DataFrame | None = None, preferred_max_frac: float = 0.5) -> DataFrame:
    """cell_id, round (from 1). Points keep their distance within a round only; later rounds draw
    from what is left, preferred points first up to a share of the round."""
    hashed = F.xxhash64(F.lit(seed), F.col("cell_id"))
    liked = None if preferred is None else save(preferred.select("cell_id").distinct(), "liked")
    taken, total, number = None, 0, 1
    while total < target_total:
        rest = points if taken is None else points.join(taken, "cell_id", "left_anti")
        want = min(first_round_n, target_total) if number == 1 else min(per_round, target_total - total)
        if number == 1:
            rest = rest.orderBy(hashed, "cell_id").limit(first_round_candidates)
        ranked = rest.select("cell_id", "x", "y", F.xxhash64(F.lit(seed + number), F.col("cell_id")).alias("h"))
        if liked is not None:
            # beyond the share, the other preferred points stay out of this round
            some = ranked.join(liked, "cell_id", "left_semi").orderBy("h", "cell_id").limit(int(want * preferred_max_frac)).withColumn("late", F.lit(0))
            ranked = some.unionByName(ranked.join(liked, "cell_id", "left_anti").withColumn("late", F.lit(1)))
        else:
            ranked = ranked.withColumn("late", F.lit(0))
        ranked = ranked.withColumn("turn", F.struct("late", "h"))
        now = save(poisson_disk(ranked, r, "given", given="turn", target_n=want).select("cell_id", F.lit(number).alias("round")), "round")
        n = now.count()
        if not n:
            break
        if number == 1 and per_round is None:
            per_round = max(n // 25 * 25, 25)
        taken = now if taken is None else taken.unionByName(now)
        total, number = total + n, number + 1
    if taken is None:
        return points.select("cell_id", F.lit(0).alias("round")).limit(0)
    return taken


# ------------------------------------------------------------------ profiles


def impulse_signals(points: DataFrame, rounds: DataFrame, n_rounds: int) -> DataFrame:
    """cell_id, vec: one column a round, 1 at its seeds."""
    one = F.transform(F.sequence(F.lit(1), F.lit(max(1, n_rounds))), lambda i: F.when(i == F.col("round"), 1.0).otherwise(0.0))
    return points.select("cell_id").join(rounds.select("cell_id", "round"), "cell_id", "left").withColumn("round", F.coalesce("round", F.lit(0))).select("cell_id", one.alias("vec"))


def _wide(responses: DataFrame) -> tuple[DataFrame, list[float]]:
    """cell_id, vecs: the responses of a cell, one vector a scale (null: none); and the scales."""
    scales = sorted(r[0] for r in responses.select("scale").distinct().collect())
    entries = F.map_from_entries(F.collect_list(F.struct("scale", "vec")))
    return responses.groupBy("cell_id").agg(entries.alias("m")).select("cell_id", F.array(*[F.try_element_at("m", F.lit(s)) for s in scales]).alias("vecs")), scales


#: Responses of a cell, over scales and rounds, up to which it takes them along to where it meets seeds.
CARRIED = 16


def _placed(points: DataFrame, rounds: DataFrame, wide: DataFrame, n_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Seeds (cell_id, x, y, round) and cells (cell_id, x, y, flat: values by scale and round, held: by scale whether there are any)."""
    at_round = lambda v, i: F.try_element_at(v, i).cast("double")
    flat = F.flatten(F.transform("vecs", lambda v: F.transform(F.sequence(F.lit(1), F.lit(n_rounds)), lambda i: at_round(v, i))))
    held = F.transform("vecs", lambda v: v.isNotNull().cast("int"))
    placed = points.select("cell_id", "x", "y").filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    seeds = placed.join(rounds.select("cell_id", F.col("round").cast("long").alias("round")), "cell_id")
    return seeds, placed.join(wide.select("cell_id", flat.alias("flat"), held.alias("held")), "cell_id")


def _profile_rows(scales: list[float], n_rounds: int, cut: float, by_self: bool, least: float | None, digits: tuple[int | None, int | None]):
    """For radius_rows: a row a pair and scale."""

    def rows(asking: pa.Table, targets: pa.Table):
        seed, nbr, rounds = taker(asking["cell_id"]), taker(targets["cell_id"]), asking["round"].to_numpy()
        held = _matrix(targets["held"], len(scales)) > 0
        flat = pa.concat_arrays([pa.array([], pa.float64()), *(c.flatten() for c in targets["flat"].chunks)])
        absent = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0.0).to_numpy()
        if cut > 0:
            absent |= values < cut
        if not by_self:
            values = rounded(values, digits[1])
        elif len(asking):
            own = asking["own"].combine_chunks()
            given = own.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(scales))
            own = _matrix(asking["own"], len(scales))
        any_absent = absent.any()

        def made(i: np.ndarray, j: np.ndarray, dist: np.ndarray):
            dist = rounded(dist, digits[0])
            for s, scale in enumerate(scales):
                keep = held[j, s]
                if by_self and least is not None:
                    keep = keep & given[i, s] & ~(own[i, s] <= least)
                a, b, d = (i, j, dist) if keep.all() else (i[keep], j[keep], dist[keep])
                at = (b * len(scales) + s) * n_rounds + rounds[a] - 1
                v = values[at]
                if by_self:
                    v = rounded(np.where(given[a, s], v / np.where(given[a, s], own[a, s], 1.0), v), digits[1])
                yield [seed(a), pa.array(rounds[a]), nbr(b), pa.array(d), pa.array(np.full(len(a), float(scale))), pa.array(v, mask=absent[at]) if any_absent else pa.array(v)]

        return made

    return rows


def seed_profiles(points: DataFrame, rounds: DataFrame, responses: DataFrame, radius: float) -> DataFrame:
    """seed_id, round, nbr_id, distance, scale, intensity: what each seed's own round carried to
    the cells around it. responses(cell_id, scale_idx, scale, vec).

    Where cells have few responses they bring them to the seeds, and no pair is shuffled; long ones
    are joined to the pairs."""
    n_rounds = rounds.agg(F.max("round")).first()[0] or 1
    wide, scales = _wide(responses)
    if scales and n_rounds * len(scales) <= CARRIED:
        return _carried(points, rounds, wide, scales, n_rounds, radius)
    seeds = points.join(rounds, "cell_id").select("cell_id", "x", "y", "round")
    near = radius_join(seeds, points, radius).join(seeds.select(F.col("cell_id").alias("src"), "round"), "src")
    rows = near.join(responses.withColumnRenamed("cell_id", "dst"), "dst").withColumnsRenamed({"src": "seed_id", "dst": "nbr_id"})
    return rows.select("seed_id", "round", "nbr_id", F.col("dist").alias("distance"), "scale", F.col("vec")[F.col("round") - 1].alias("intensity"))


def _carried(points: DataFrame, rounds: DataFrame, wide: DataFrame, scales: list[float], n_rounds: int, radius: float, cut: float = 0.0, by_self: bool = False, least: float | None = None, digits: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    seeds, cells = _placed(points, rounds, wide, n_rounds)
    kinds = [c.schema["cell_id"].dataType.simpleString() for c in (seeds, cells)]
    if by_self:  # a seed takes its own along, null where it has none
        left = (lambda v: F.when(v >= cut, v)) if cut > 0 else (lambda v: v)
        mine = lambda v: F.try_element_at(v, F.col("round").cast("int")).cast("double")
        own = F.transform("vecs", lambda v: F.when(v.isNotNull(), F.greatest(left(mine(v)), F.lit(1e-12))))
        seeds = seeds.join(wide, "cell_id", "left").withColumn("own", F.coalesce(own, F.array_repeat(F.lit(None).cast("double"), len(scales)))).drop("vecs")
    rows = radius_rows(seeds, cells, radius, _profile_rows(scales, n_rounds, cut, by_self, least, digits), f"seed_id {kinds[0]}, round long, nbr_id {kinds[1]}, distance double, scale double, intensity double")
    return rows.withColumn("round", F.col("round").cast(rounds.schema["round"].dataType))


def near_profiles(points: DataFrame, rounds: DataFrame, responses: DataFrame, x_max: float, cut: float = 0.0, by_self: bool = False, least: float | None = None, digits: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """What clean_profiles makes of seed_profiles (of a radius of x_max or more), without a shuffle of pairs: a seed takes its
    own intensity along. With `least`, only of seeds and scales whose own is above. Distances and intensities
    are rounded to digits, if given."""
    wide, scales = _wide(responses)
    n_rounds = rounds.agg(F.max("round")).first()[0] or 1
    return _carried(points, rounds, wide, scales, n_rounds, x_max, cut, by_self, least, digits)


def manifest(profiles: DataFrame, cells: DataFrame, columns: list[str] | None = None, radius: float | None = None) -> DataFrame:
    """One row a seed, with its neighbour count and columns of cells: all (None), some or none;
    never one that the manifest has already."""
    if "n_neighbors" in profiles.columns:  # a row a seed, of binned_profiles
        base = profiles.select("seed_id", "round", "n_neighbors", F.lit(radius).cast("double").alias("radius"))
    else:
        base = profiles.groupBy("seed_id", "round").agg(F.countDistinct("nbr_id").alias("n_neighbors"), F.lit(radius).cast("double").alias("radius"))
    wanted = [c for c in cells.columns if c != "cell_id"] if columns is None else columns
    return base.join(cells.select(F.col("cell_id").alias("seed_id"), *[c for c in wanted if c not in base.columns]), "seed_id", "left")


# ------------------------------------------------------------------ heatmap


def bin_count(x_max: float, width: float) -> int:
    return len(np.arange(0.0, x_max + width, width)) - 1


def distance_bins(profiles: DataFrame, x_max: float, width: float) -> DataFrame:
    """seed_id, bin, n of neighbours within x_max; the last bin is closed."""
    near = profiles.select("seed_id", "nbr_id", "distance").distinct().filter(F.col("distance") <= x_max)
    at = F.least(F.floor(F.col("distance") / width), F.lit(bin_count(x_max, width) - 1)).cast("int")
    return near.groupBy("seed_id", at.alias("bin")).agg(F.count("*").alias("n"))


def clean_profiles(profiles: DataFrame, x_max: float, cut: float = 0.0, by_self: bool = False) -> DataFrame:
    """Within x_max; intensities below the cut become null; optionally relative to the seed's own."""
    v = F.col("intensity")
    rows = profiles.filter(F.col("distance") <= x_max)
    if cut > 0:
        rows = rows.withColumn("intensity", F.when(v >= cut, v))
    if by_self:
        own = rows.filter("nbr_id = seed_id").select("seed_id", "scale", F.greatest("intensity", F.lit(1e-12)).alias("own"))
        rows = rows.join(own, ["seed_id", "scale"], "left").withColumn("intensity", F.when(F.col("own").isNull(), v).otherwise(v / F.col("own"))).drop("own")
    return rows


def interpolate(rows: DataFrame, x_max: float, width: float) -> DataFrame:
    """seed_id, scale, bin, value: linear interpolation at the bin centres, for profiles of two
    finite points or more, none outside their range. Of points at one distance the last counts."""
    n = bin_count(x_max, width)
    own = Window.partitionBy("seed_id", "scale").orderBy("distance", "nbr_id")
    all_ = Window.partitionBy("seed_id", "scale")
    x, y = F.col("distance"), F.col("intensity")
    seg = rows.filter(y.isNotNull() & ~F.isnan(y)).select("seed_id", "scale", x.alias("x0"), y.alias("y0"), F.lead(x).over(own).alias("x1"), F.lead(y).over(own).alias("y1"), F.count("*").over(all_).alias("k")).filter("k >= 2")
    # each segment makes the bins whose centres lie in it; no join is needed
    first = F.greatest(F.lit(0), F.floor(F.col("x0") / width - 0.5))
    last = F.least(F.lit(n - 1), F.floor(F.coalesce("x1", "x0") / width - 0.5) + 1)
    bins = seg.filter(first <= last).withColumn("bin", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    c = (F.col("bin") + 0.5) * width
    inside = F.when(F.col("x1").isNull(), c == F.col("x0")).otherwise((c >= F.col("x0")) & (c < F.col("x1")))
    value = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * F.try_divide(c - F.col("x0"), F.col("x1") - F.col("x0")))
    return bins.filter(inside).select("seed_id", "scale", "bin", value.alias("value"))


#: Distances that a task holds at a time; seeds of a tile, which share the cells they look at.
SLAB, TILE_SEEDS = 1 << 22, 64


def _lists(flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), kind))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix; nulls are NaN."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _nearest_to_centers(d: np.ndarray, y: np.ndarray, centers: np.ndarray, lo: tuple, hi: tuple) -> None:
    """Fill, for each row of distances and each centre, the column of the last one up to the centre and of
    the first one beyond it. Columns ascend by id, so of equal distances the last and the first count."""
    rows, last = np.arange(len(d)), d.shape[1] - 1
    for b, c in enumerate(centers):
        inside = d <= c
        least = np.where(inside, d, -np.inf).max(1)
        near = least > -np.inf
        lo[0][:, b], lo[1][:, b] = least, np.where(near, last - (d == least[:, None])[:, ::-1].argmax(1), 0)
        beyond = np.where(inside, np.inf, d).argmin(1)
        hi[0][:, b], hi[1][:, b] = np.where(inside[rows, beyond], np.inf, d[rows, beyond]), beyond


def _binned(radius: float, x_max: float, width: float, n_scales: int, n_rounds: int, cut: float, kind: pa.DataType):
    """In tasks, of a block of seeds and a part of the cells around: neighbours, counts by bin, and for each
    scale and bin the two points that the bin's centre lies between.

    Seeds that lie near each other share bounds of their distance to a cell, so that a pair is only looked at
    where a bin's end or centre lies between them."""
    n = bin_count(x_max, width)
    centers = (np.arange(n) + 0.5) * width
    names = ["seed_id", "round", "n_neighbors", "counts", "k", "lo_d", "lo_id", "lo_y", "hi_d", "hi_id", "hi_y"]
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), kind, pa.float64(), pa.float64(), kind, pa.float64()]
    schema = pa.schema([(c, k if i < 3 else pa.list_(k)) for i, (c, k) in enumerate(zip(names, kinds, strict=True))])

    def run(asking: pa.Table, targets: pa.Table) -> pa.Table:
        targets = targets.sort_by("cell_id")
        if not len(asking) or not len(targets):
            return schema.empty_table()
        ax, ay, bx, by = (t.column(c).to_numpy().astype(float) for t in (asking, targets) for c in ("x", "y"))
        seeds, ids = asking.column("cell_id").combine_chunks(), targets.column("cell_id").combine_chunks()
        rounds = asking.column("round").to_numpy().astype(int)
        own = _matrix(asking.column("own"), n_scales)
        values = _matrix(targets.column("flat"), n_scales * n_rounds).reshape(-1, n_scales, n_rounds)
        made = []
        cap = min(x_max, radius)
        tile = max(1, min(TILE_SEEDS, SLAB // len(ids)))
        for r in np.unique(rounds):
            v = values[:, :, r - 1] if 1 <= r <= n_rounds else np.full(values.shape[:2], np.nan)
            usable = ~np.isnan(v) & ((v >= cut) | (cut <= 0))
            alike: dict[bytes, list[int]] = {}  # scales that the same cells have values of
            for i in range(n_scales):
                alike.setdefault(usable[:, i].tobytes(), []).append(i)
            mine = np.flatnonzero(rounds == r)
            for own_rows in _tiles(ax[mine], ay[mine], tile):
                rows = mine[own_rows]
                m, (near, far) = len(rows), _reach(ax[rows], ay[rows], bx, by)

                def away(cols: np.ndarray, rows=rows) -> np.ndarray:
                    dx, dy = ax[rows, None] - bx[None, cols], ay[rows, None] - by[None, cols]
                    return np.sqrt(dx * dx + dy * dy)

                def within(cut_off: float, holds, near=near, far=far, of=None) -> np.ndarray:
                    """Targets up to the distance, of which only those that a seed may have beyond it are looked at."""
                    some = np.flatnonzero((near <= cut_off * (1 + 1e-9)) & (far >= cut_off * (1 - 1e-9)))
                    return np.count_nonzero(far < cut_off * (1 - 1e-9)) + np.count_nonzero(holds(away(some if of is None else of[some])), 1)

                seen = within(radius, lambda d: d <= radius)
                upto = [within(min(width * (b + 1), cap), lambda d, b=b: (d / width < b + 1) & (d <= cap)) for b in range(n - 1)] + [within(cap, lambda d: d <= cap)]
                counts = np.diff(np.stack(upto, 1), axis=1, prepend=0)
                k = np.zeros((m, n_scales), int)
                ends = [np.full((m, n_scales, n), x) for x in (-np.inf, 0, np.nan, np.inf, 0, np.nan)]
                ends[1], ends[4] = ends[1].astype(int), ends[4].astype(int)
                for which in alike.values():
                    cols = np.flatnonzero(usable[:, which[0]])
                    if not len(cols):
                        continue
                    part = (near, far) if len(cols) == len(ids) else (near[cols], far[cols])
                    lo, hi = ((np.full((m, n), x), np.zeros((m, n), int)) for x in (-np.inf, np.inf))
                    for b, c in enumerate(centers):
                        # every seed has a target between these bounds on either side of the centre
                        least = part[0][part[1] <= min(c, cap)].max(initial=-np.inf)
                        most = part[1][(part[0] > c) & (part[1] <= cap)].min(initial=cap)
                        some = np.flatnonzero((part[0] <= most) & (part[1] >= least))
                        if len(some):
                            d = away(cols[some])
                            d[d > cap] = np.inf
                            at_lo, at_hi = ((e[0][:, b : b + 1], e[1][:, b : b + 1]) for e in (lo, hi))
                            _nearest_to_centers(d, v, centers[b : b + 1], at_lo, at_hi)
                            at_lo[1][...], at_hi[1][...] = some[at_lo[1]], some[at_hi[1]]
                    enough = upto[-1] if len(cols) == len(ids) else within(cap, lambda d: d <= cap, *part, of=cols)
                    for i in which:
                        fit = ~np.isnan(own[rows, i])
                        k[:, i] = np.where(fit, enough, 0)
                        for e, (dist, col) in enumerate((lo, hi)):
                            ends[3 * e][:, i] = np.where(fit[:, None], dist, (-np.inf, np.inf)[e])
                            ends[3 * e + 1][:, i] = cols[col]
                            ends[3 * e + 2][:, i] = v[cols[col], i] / own[rows, i, None]
                some = seen > 0
                flat = [e.reshape(m, -1)[some] for e in ends]
                name = lambda e: pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1) * e.shape[1], pa.int32()), ids.take(pa.array(e.ravel())))
                lists = [_lists(counts[some], pa.int64()), _lists(k[some], pa.int64()), _lists(flat[0], pa.float64()), name(flat[1]), _lists(flat[2], pa.float64()), _lists(flat[3], pa.float64()), name(flat[4]), _lists(flat[5], pa.float64())]
                made.append(pa.Table.from_arrays([seeds.take(pa.array(rows[some])), pa.array(np.full(some.sum(), r), pa.int64()), pa.array(seen[some], pa.int64()), *lists], schema=schema))
        return pa.concat_tables(made)

    return run


def binned_profiles(points: DataFrame, rounds: DataFrame, responses: DataFrame, radius: float, x_max: float, width: float, cut: float = 0.0, by_self: bool = False) -> DataFrame:
    """seed_id, round, n_neighbors (within the radius), counts (by bin), scales, values (by scale and
    bin): what clean_profiles, distance_bins and interpolate make of seed_profiles, without a
    table of pairs.

    A bin's value lies between the last point up to its centre and the first beyond. Tasks find both
    for a block of seeds and a part of the cells around; a seed's parts are put together by their
    order, so disk and shuffle grow with the seeds and parts, time with the pairs."""
    wide, scales = _wide(responses)
    n, n_rounds = bin_count(x_max, width), max(1, rounds.agg(F.max("round")).first()[0] or 1)
    kind = points.schema["cell_id"].dataType
    at_round = lambda v, i: F.try_element_at(v, i).cast("double")
    flat = F.flatten(F.transform("vecs", lambda v: F.transform(F.sequence(F.lit(1), F.lit(n_rounds)), lambda i: at_round(v, i))))
    cells = points.select("cell_id", "x", "y").join(wide.select("cell_id", flat.alias("flat")), "cell_id")
    cells = cells.filter(~F.isnan("x") & ~F.isnan("y"))
    seeds = points.select("cell_id", "x", "y").join(rounds.select("cell_id", F.col("round").cast("long").alias("round")), "cell_id").filter(~F.isnan("x") & ~F.isnan("y"))
    if by_self:  # relative to the seed's own, where it has one
        mine = lambda v: at_round(v, F.col("round").cast("int"))
        left = (lambda v: F.when(v >= cut, v)) if cut > 0 else (lambda v: v)
        own = F.coalesce(F.transform("vecs", lambda v: F.when(v.isNull(), 1.0).otherwise(F.greatest(left(mine(v)), F.lit(1e-12)))), F.array_repeat(F.lit(1.0), len(scales)))
        seeds = seeds.join(wide, "cell_id", "left").withColumn("own", own).drop("vecs")
    else:
        seeds = seeds.withColumn("own", F.array_repeat(F.lit(1.0), len(scales)))
    name = kind.simpleString()
    schema = f"seed_id {name}, round long, n_neighbors long, counts array<long>, k array<long>, lo_d array<double>, lo_id array<{name}>, lo_y array<double>, hi_d array<double>, hi_id array<{name}>, hi_y array<double>"
    arrow = pa.int64() if name == "bigint" else pa.int32() if name == "int" else pa.string()
    found = radius_groups(seeds, cells, radius, _binned(radius, x_max, width, len(scales), n_rounds, cut, arrow), schema)
    end = lambda e: F.arrays_zip(F.col(f"{e}_d").alias("d"), F.col(f"{e}_id").alias("id"), F.col(f"{e}_y").alias("y"))
    parts = found.select("seed_id", "round", F.struct("n_neighbors", "counts", "k", end("lo").alias("lo"), end("hi").alias("hi")).alias("p"))
    add = lambda f, g: F.aggregate(F.slice(F.transform("ps", lambda p: p[f]), 2, 1 << 30), F.col("ps")[0][f], lambda t, p: F.zip_with(t, p, g))
    plus = lambda a, b: a + b
    whole = parts.groupBy("seed_id", "round").agg(F.sum("p.n_neighbors").alias("n_neighbors"), F.collect_list("p").alias("ps"))
    whole = whole.select("seed_id", "round", "n_neighbors", add("counts", plus).alias("counts"), add("k", plus).alias("k"), add("lo", lambda a, b: F.greatest(a, b)).alias("lo"), add("hi", lambda a, b: F.least(a, b)).alias("hi"))

    def value(e, i):
        lo, hi, c = e["lo"], e["hi"], (i % n + 0.5) * width
        between = lo["y"] + (hi["y"] - lo["y"]) * F.try_divide(c - lo["d"], hi["d"] - lo["d"])
        found = F.when(hi["d"] < float("inf"), between).when(lo["d"] == c, lo["y"])
        return F.when((F.get("k", F.floor(i / n).cast("int")) >= 2) & (lo["d"] > float("-inf")), found)

    values = F.transform(F.arrays_zip("lo", "hi"), value)
    return save(whole.select("seed_id", "round", "n_neighbors", "counts", F.array(*map(F.lit, scales)).cast("array<double>").alias("scales"), values.alias("values")), "binned")


def binned_counts(binned: DataFrame) -> DataFrame:
    """seed_id, bin, n, as of distance_bins."""
    return binned.select("seed_id", F.posexplode("counts").alias("bin", "n")).filter("n > 0")


def binned_values(binned: DataFrame) -> DataFrame:
    """seed_id, scale, bin, value, as of interpolate."""
    each = binned.select("seed_id", "scales", F.size("counts").alias("n"), F.posexplode("values").alias("at", "value")).filter("value IS NOT NULL")
    return each.select("seed_id", F.get("scales", F.floor(F.col("at") / F.col("n")).cast("int")).alias("scale"), (F.col("at") % F.col("n")).alias("bin"), "value")


#: Seeds of a stored block of profiles, at most.
BLOCK_SEEDS = 4096


def _blocks(radius: float, scales: list[float], n_rounds: int, kind: pa.DataType):
    """In tasks, of a block of seeds and a part of the cells around: a row a round, scale and BLOCK_SEEDS seeds
    that lie near each other, with the cells that any of them may reach."""
    place = [("id", kind), ("x", pa.float64()), ("y", pa.float64())]
    seed, cell = pa.struct(place), pa.struct([*place, ("value", pa.float64())])
    schema = pa.schema([("round", pa.int64()), ("scale", pa.float64()), ("seeds", pa.list_(seed)), ("cells", pa.list_(cell))])

    def run(asking: pa.Table, targets: pa.Table) -> pa.Table:
        ax, ay, bx, by = (t.column(c).to_numpy().astype(float) for t in (asking, targets) for c in ("x", "y"))
        names, ids = asking.column("cell_id").combine_chunks(), targets.column("cell_id").combine_chunks()
        rounds = asking.column("round").to_numpy().astype(int)
        held = _matrix(targets.column("held"), len(scales)) > 0
        values = pa.concat_arrays([pa.array([], pa.float64()), *(c.flatten() for c in targets.column("flat").chunks)])
        made: list[list] = [[], [], [], []]
        for r in np.unique(rounds):
            mine = np.flatnonzero(rounds == r)
            for own in _tiles(ax[mine], ay[mine], BLOCK_SEEDS) if len(ids) else []:
                rows = mine[own]
                near = _reach(ax[rows], ay[rows], bx, by)[0] <= radius * (1 + 1e-9)
                seeds = pa.StructArray.from_arrays([names.take(pa.array(rows)), pa.array(ax[rows]), pa.array(ay[rows])], fields=list(seed))
                for i, scale in enumerate(scales):
                    some = np.flatnonzero(near & held[:, i])
                    if len(some):
                        at = values.take(pa.array((some * len(scales) + i) * n_rounds + r - 1))
                        cells = pa.StructArray.from_arrays([ids.take(pa.array(some)), pa.array(bx[some]), pa.array(by[some]), at], fields=list(cell))
                        for column, v in zip(made, (int(r), float(scale), seeds, cells), strict=True):
                            column.append(v)
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, m)]), pa.int32()), pa.concat_arrays(m) if m else pa.array([], t)) for m, t in zip(made[2:], (seed, cell), strict=True)]
        return pa.Table.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.float64()), *lists], schema=schema)

    return run


def profile_blocks(points: DataFrame, rounds: DataFrame, responses: DataFrame, radius: float) -> DataFrame:
    """round, scale, seeds (id, x, y), cells (id, x, y, value): seed_profiles by blocks, to be stored. A cell is held
    once for up to BLOCK_SEEDS seeds, not in a row a pair; `profile_rows` gives those rows."""
    wide, scales = _wide(responses)
    n_rounds = max(1, rounds.agg(F.max("round")).first()[0] or 1)
    kind = points.schema["cell_id"].dataType.simpleString()
    seeds, cells = _placed(points, rounds, wide, n_rounds)
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    place = f"id: {kind}, x: double, y: double"
    return radius_groups(seeds, cells, radius, _blocks(radius, scales, n_rounds, arrow), f"round long, scale double, seeds array<struct<{place}>>, cells array<struct<{place}, value: double>>")


def profile_rows(blocks: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """What seed_profiles gives, of its blocks, each read by a task that makes some pairs at a time. Spark's inline
    would hold all rows of a block before the next operator takes them."""
    kind = blocks.schema["seeds"].dataType.elementType["id"].dataType.simpleString()
    of = blocks.schema["round"].dataType
    names = ["seed_id", "round", "nbr_id", "distance", "scale", "intensity"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seeds, cells = (pa.Table.from_arrays(batch.column(c)[k].values.flatten(), names=n) for c, n in (("seeds", ["cell_id", "x", "y"]), ("cells", ["cell_id", "x", "y", "value"])))
                seed, nbr, value = taker(seeds["cell_id"]), taker(cells["cell_id"]), cells["value"].combine_chunks()
                absent, plain = value.is_null().to_numpy(zero_copy_only=False), rounded(value.fill_null(0.0).to_numpy(), digits)
                r, scale = batch.column("round")[k].as_py(), batch.column("scale")[k].as_py()
                for i, j, dist in within(seeds, cells, radius):
                    columns = [seed(i), pa.array(np.full(len(i), r)), nbr(j), pa.array(rounded(dist, digits)), pa.array(np.full(len(i), scale)), pa.array(plain[j], mask=absent[j])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"seed_id {kind}, round long, nbr_id {kind}, distance double, scale double, intensity double"
    # files are few and small beside the pairs they hold, so blocks are dealt to tasks of their own
    tasks = max(1, min(GROUP_TASKS, blocks.count()))
    dealt = blocks.select("round", "scale", "seeds", "cells").repartition(tasks, F.col("seeds")[0]["id"], F.col("cells")[0]["id"], "scale")
    return dealt.mapInArrow(run, schema).withColumn("round", F.col("round").cast(of))


def smooth(grid: DataFrame, n_bins: int, sigma: float, keys: tuple[str, ...] = ("seed_id", "scale")) -> DataFrame:
    """Gaussian smoothing along bins that ignores absent ones; ends are repeated outward."""
    r = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    taps: dict[tuple[int, int], float] = {}
    for b in range(n_bins):
        for o in range(-r, r + 1):
            s = min(max(b + o, 0), n_bins - 1)
            taps[b, s] = taps.get((b, s), 0.0) + float(g[o + r])
    kernel = grid.sparkSession.createDataFrame([(b, s, w) for (b, s), w in sorted(taps.items())], "to int, bin int, g double")
    sums = grid.join(F.broadcast(kernel), "bin").groupBy(*keys, F.col("to").alias("bin")).agg(F.sum(F.col("g") * F.col("value")).alias("v"), F.sum("g").alias("m"))
    return sums.filter("m > 1e-6").select(*keys, "bin", (F.col("v") / F.col("m")).alias("value"))


def heatmap(profiles: DataFrame, x_max: float = 500, width: float = 5, cut: float = 0.0, by_self: bool = False, normalize_rows: bool = True, counts_weight: bool = True, sigma: float = 0.0, percentile: float = 0.95, groups: DataFrame | None = None, unbiased: bool = False) -> tuple[DataFrame, DataFrame]:
    """-> H(grp, scale, bin, center, value) and E(grp, scale, distance).

    groups(seed_id, grp) adds a heatmap for each group beside that of all seeds ('All'), in one
    pass. With counts_weight each seed's bin weighs its neighbours, and the denominator counts
    them even where the seed has no value, unless unbiased. E is the first bin centre at which the
    share of the unnormalised sum reaches the percentile. Scale 0 is 1 in the first bin."""
    n = bin_count(x_max, width)
    if "values" in profiles.columns:  # of binned_profiles, which took x_max, width, cut and by_self already
        grid, counts = binned_values(profiles), binned_counts(profiles)
        seeds = profiles.filter(F.exists("counts", lambda c: c > 0)).select("seed_id")
        scales = profiles.select(F.explode("scales").alias("scale")).distinct()
    else:
        rows = clean_profiles(profiles, x_max, cut, by_self)
        grid, counts = interpolate(rows, x_max, width), distance_bins(rows, x_max, width)
        seeds, scales = rows.select("seed_id").distinct(), rows.select("scale").distinct()
    if sigma > 0:
        grid = smooth(grid, n, sigma)
    member = seeds.withColumn("grp", F.lit("All"))
    if groups is not None:
        member = member.unionByName(seeds.join(groups.select("seed_id", "grp").filter("grp IS NOT NULL"), "seed_id").select("seed_id", "grp"))
    if counts_weight:
        num = grid.join(counts, ["seed_id", "bin"]).join(member, "seed_id").groupBy("grp", "scale", "bin").agg(F.sum(F.col("value") * F.col("n")).alias("num"), F.sum("n").alias("own"))
        den = counts.join(member, "seed_id").groupBy("grp", "bin").agg(F.sum("n").alias("den"))
    else:
        num = grid.join(member, "seed_id").groupBy("grp", "scale", "bin").agg(F.sum("value").alias("num"), F.count("*").alias("own"))
        den = num.groupBy("grp", "bin").agg(F.lit(None).cast("long").alias("den"))
    bins = profiles.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    full = member.select("grp").distinct().crossJoin(F.broadcast(scales)).crossJoin(F.broadcast(bins))
    cells = full.join(num, ["grp", "scale", "bin"], "left").join(den, ["grp", "bin"], "left")
    weight = F.coalesce("own" if unbiased or not counts_weight else "den", F.lit(0))
    cells = cells.withColumn("num", F.coalesce("num", F.lit(0.0))).withColumn("value", F.col("num") / F.greatest(weight.cast("double"), F.lit(1e-12)))
    center = (F.col("bin") + 0.5) * width
    zero = F.abs("scale") <= 1e-6
    along = Window.partitionBy("grp", "scale")
    upto = along.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("num").over(along)
    energy = cells.select("grp", "scale", "bin", (F.when(total > 0, F.sum("num").over(upto) / total)).alias("share")).groupBy("grp", "scale").agg(F.min(F.when(F.col("share") >= percentile, center)).alias("distance"))
    value = F.col("value")
    if normalize_rows:
        row = F.sum("value").over(along)
        value = F.when(row > 1e-12, F.col("value") / row).otherwise(F.col("value"))
    table = cells.select("grp", "scale", "bin", center.alias("center"), value.alias("value"))
    delta = member.select("grp").distinct().crossJoin(F.broadcast(bins)).select("grp", F.lit(0.0).alias("scale"), "bin", center.alias("center"), (F.col("bin") == 0).cast("double").alias("value"))
    table = table.filter(~zero).unionByName(delta)
    energy = energy.filter(~zero).unionByName(member.select("grp").distinct().select("grp", F.lit(0.0).alias("scale"), F.lit(0.0).alias("distance")))
    return table, energy


def wide_heatmap(table: DataFrame) -> DataFrame:
    """One row a scale, a column dist_<center> a bin."""
    name = F.concat(F.lit("dist_"), F.format_string("%.2f", F.col("center")))
    centers = [r[0] for r in table.select("bin", name.alias("n")).distinct().orderBy("bin").select("n").collect()]
    return table.withColumn("n", name).groupBy("grp", "scale").pivot("n", centers).agg(F.first("value"))


# ------------------------------------------------------------------ all of it


def map_scales_to_distance(points: DataFrame, edges: DataFrame, typical_scales: list[float] | None = None, density_radius: float = 20, density_percentile: float = 10, sample_r: float = 500, target_total: int = 2000, first_round_n: int = 400, first_round_candidates: int = 10_000, preferred_max_frac: float = 0.6, scales: list[float] | None = None, radius: float = 250, x_max: float = 125, width: float = 1, normalize_rows: bool = True, seed: int = 0, groups: tuple[str, ...] = ("Low", "Medium", "High"), path: str | None = None) -> dict[str, DataFrame]:
    """cells (density and group), rounds, profiles, manifest, heatmap and energy tables; written to path."""
    scales = sorted({round(s, 4) for s in (scales or MAPPING_SCALES)} | {round(s, 4) for s in typical_scales or ()})
    cells = save(density_groups(density(points, density_radius), percentile=density_percentile), "density")
    preferred = cells.filter(F.col("density_group").isin("High", "Low"))
    rounds = save(sample_rounds(points, sample_r, target_total, seed, first_round_n, first_round_candidates, None, preferred, preferred_max_frac), "rounds")
    n_rounds = rounds.agg(F.max("round")).first()[0] or 0
    responses = heat_filter(edges, impulse_signals(points, rounds, n_rounds), scales, points=points)
    profiles = save(seed_profiles(points, rounds, responses, radius), "profiles")
    grouping = cells.filter(F.col("density_group").isin(*groups)).select(F.col("cell_id").alias("seed_id"), F.col("density_group").alias("grp"))
    table, energy = heatmap(profiles, x_max, width, normalize_rows=normalize_rows, counts_weight=False, groups=grouping)
    out = {"cells": cells, "rounds": rounds, "profiles": profiles, "manifest": manifest(profiles, cells, radius=radius), "heatmap": table, "energy": energy}
    if path:
        write_mapping(out, path)
    return out
