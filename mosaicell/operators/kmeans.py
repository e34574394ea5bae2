"""Mini-batch k-means: steps over hashed batches in tasks, centres on the driver.

Each step reads one batch's folder, assigns its vectors in tasks and moves the centres by counts
per centre, so that a centre's step shrinks as it has seen more. Centres with next to no members
move to the vectors farthest from theirs. Steps stop after a time without improvement of the smoothed
cost. A batch holds BATCH vectors, or a FOLDERS-th of a larger table. Where one batch is the
whole table, steps are those of full k-means, on the driver, as BATCH bounds it. What the driver
holds is the centres and a first sample of three batches.

Ties go to the centre of the least number; repeated vectors count each; no vectors give no centres. Vectors that
are null or hold a null or NaN are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import save, scratch

PASSES, STALE, BATCH, FOLDERS = 300, 30, 10_000, 256
#: Centres below this share of the largest count are placed anew, at every tenth step.
REASSIGN, EVERY = 0.01, 10
#: A smoothed cost that is not lower by this share counts as no improvement.
BETTER = 1e-3
#: Vectors a task offers as new places.
FAR = 32


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


class CenterTree:
    """Centres in about sqrt(k) groups: a vector looks into its nearest group, and by the triangle
    inequality into those that could hold a nearer centre. The nearest centre is exact."""

    def __init__(self, centers: np.ndarray):
        self.centers, self.middle = centers, centers.mean(0)
        c = centers - self.middle
        heads = c[np.linspace(0, len(c) - 1, max(1, round(len(c) ** 0.5))).astype(int)]
        for _ in range(4):
            own = _squares(c, heads).argmin(1)
            heads = np.stack([c[own == g].mean(0) if (own == g).any() else heads[g] for g in range(len(heads))])
        own = _squares(c, heads).argmin(1)
        self.members = [np.flatnonzero(own == g) for g in range(len(heads))]
        held = [g for g, m in enumerate(self.members) if len(m)]
        self.heads, self.members = heads[held], [self.members[g] for g in held]
        self.reach = np.array([np.sqrt(_squares(c[m], h[None]).max()) for m, h in zip(self.members, self.heads, strict=True)])

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centre and the squared distance to it."""
        parts = [self._nearest(v[s : s + 4096] - self.middle) for s in range(0, len(v), 4096)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, int), np.zeros(0))

    def _nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, away = self.centers - self.middle, np.sqrt(_squares(v, self.heads))
        first = away.argmin(1)
        at, best = np.full(len(v), -1), np.full(len(v), np.inf)
        # distances by products are a little rough
        slack = 1e-6 * (1 + np.abs(v).max(initial=0) + np.abs(c).max(initial=0))
        for own_turn in (True, False):
            for g, m in enumerate(self.members):
                rows = np.flatnonzero(first == g if own_turn else (first != g) & (away[:, g] - self.reach[g] <= np.sqrt(best) + slack))
                if not len(rows):
                    continue
                d = _squares(v[rows], c[m])
                k = d.argmin(1)
                d, k = d[np.arange(len(rows)), k], m[k]
                nearer = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
                best[rows[nearer]], at[rows[nearer]] = d[nearer], k[nearer]
        return at, best


def complete(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))


def first_centers(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over a sample; from the 16th centre on, a sixteenth of those held are drawn at a time."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(sample)))]
    d = _squares(sample, sample[picked])[:, 0]
    d[picked] = 0
    while len(picked) < k:
        want = min(max(1, len(picked) // 16), k - len(picked))
        chance = d if d.sum() > 0 else np.ones(len(d))
        want = min(want, int((chance > 0).sum()))
        new = rng.choice(len(sample), want, replace=False, p=chance / chance.sum())
        picked += new.tolist()
        d = np.minimum(d, _squares(sample, sample[new]).min(1))
        d[new] = 0
    return sample[picked]


def _moved(tree: CenterTree, blocks) -> tuple[np.ndarray, np.ndarray, float, list]:
    """Counts and sums of each centre, the cost, and the farthest vectors as (squared distance, vector)."""
    n, sums, cost, far = np.zeros(len(tree.centers)), np.zeros_like(tree.centers), 0.0, []
    for v in blocks:
        at, d = tree.nearest(v)
        n += np.bincount(at, minlength=len(n))
        np.add.at(sums, at, v)
        cost += float(d.sum())
        far = sorted(far + [(float(d[i]), v[i]) for i in np.argsort(-d, kind="stable")[:FAR]], key=lambda x: -x[0])[:FAR]
    return n, sums, cost, far


STEP = "center int, n double, cost double, vec array<double>"


def _vectors(found) -> pd.Series:
    """Vectors as a column; without a dtype an empty one would be of doubles, which is no array."""
    return pd.Series(list(found), dtype=object)


def _step(tree: CenterTree):
    """In tasks: a row for each centre met, and rows of center -1 for the farthest vectors."""

    def run(batches):
        n, sums, cost, far = _moved(tree, (np.stack(b["vec"].to_numpy()) for b in batches if len(b)))
        met = np.flatnonzero(n)
        share = np.where(np.arange(len(met)) == 0, cost, 0.0)  # the task's cost goes with one row
        yield pd.DataFrame({"center": met.astype(np.int32), "n": n[met], "cost": share, "vec": _vectors(sums[met])})
        yield pd.DataFrame({"center": np.full(len(far), -1, np.int32), "n": 0.0, "cost": [d for d, _ in far], "vec": _vectors(v for _, v in far)})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a centre of those of many tasks; of the farthest vectors the first FAR."""
    far = rows[rows["center"] < 0].sort_values("cost", ascending=False, kind="stable")[:FAR]
    own = rows[rows["center"] >= 0]
    out = [{"center": c, "n": g["n"].sum(), "cost": g["cost"].sum(), "vec": np.stack(g["vec"].to_numpy()).sum(0)} for c, g in own.groupby("center")]
    return pd.concat([pd.DataFrame(out, columns=["center", "n", "cost", "vec"]).astype({"center": "int32"}), far])


def _distributed(rows: DataFrame, tree: CenterTree, many: bool) -> tuple[np.ndarray, np.ndarray, float, list]:
    made = rows.select("vec").mapInPandas(_step(tree), STEP)
    if many:  # add up in tasks, so that the driver gets one row a centre
        made = made.groupBy(F.pmod("center", F.lit(64)).alias("g")).applyInPandas(lambda p: _added(p), STEP)
    n, sums, cost, far = np.zeros(len(tree.centers)), np.zeros_like(tree.centers), 0.0, []
    for r in made.collect():
        if r.center < 0:
            far.append((r.cost, np.array(r.vec)))
        else:
            n[r.center] += r.n
            sums[r.center] += r.vec
            cost += r.cost
    return n, sums, cost, sorted(far, key=lambda x: -x[0])[:FAR]


def minibatch_kmeans(rows: DataFrame, k: int, seed: int = 1, batch: int = BATCH, passes: int = PASSES, stale: int = STALE, report: dict | None = None) -> np.ndarray:
    """rows(cell_id, vec) -> centres, at most k. report gets the steps, the batches and the last cost."""
    spark = rows.sparkSession
    keyed = rows.select(F.xxhash64("cell_id", F.lit(seed)).alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    keyed = save(complete(keyed), "kmeans-rows")
    n = keyed.count()
    if not n:
        return np.zeros((0, 0))
    k = min(k, n)
    whole = n <= batch
    most = max(3 * batch, 3 * k)
    drawn = keyed if n <= most else keyed.filter(F.pmod("key", F.lit(1 << 30)) < int(most / n * (1 << 30)))
    sample = np.stack(drawn.orderBy("key", "vec").limit(2 * most).toPandas()["vec"].to_numpy())
    centers = first_centers(sample, k, seed)
    batches = 1 if whole else max(1, min(FOLDERS, n // batch))
    if not whole:
        # other bits of the key than the sample's
        where = scratch(spark, "kmeans-batches")
        held = keyed.withColumn("batch", F.pmod(F.shiftrightunsigned("key", 32), F.lit(batches)).cast("int"))
        held.repartition(batches, "batch").write.partitionBy("batch").parquet(where)
        held = spark.read.schema("vec array<double>, batch int").parquet(where)
    counts, smooth, best, since, steps = np.zeros(k), None, np.inf, 0, 0
    share = min(1.0, 2.0 * (n / batches) / (n + 1))
    while steps < passes * batches:
        tree = CenterTree(centers)
        if whole:
            met, sums, cost, far = _moved(tree, [sample])
            counts = np.zeros(k)
        else:
            met, sums, cost, far = _distributed(held.filter(F.col("batch") == steps % batches), tree, n // batches > 2 * batch)
        steps += 1
        size = met.sum()
        counts = counts + met
        own = met > 0
        centers = centers.copy()
        centers[own] += (sums[own] / met[own, None] - centers[own]) * (met[own] / counts[own])[:, None]
        if size:
            smooth = cost / size if smooth is None or whole else smooth * (1 - share) + cost / size * share
        rare = np.flatnonzero(counts == 0 if whole else counts < REASSIGN * counts.max()) if whole or steps % EVERY == 0 else []
        far = [v for d, v in far if d > 0]
        for c, v in zip(rare, far, strict=False):
            centers[c] = v
            counts[c] = 0 if whole else max(1.0, counts[counts > 0].min())
        moved = min(len(rare), len(far))
        if smooth is not None and (smooth < best * (1 - (1e-7 if whole else BETTER)) or (whole and moved)):
            best, since = min(best, smooth), 0
        else:
            since += 1
        if since >= (1 if whole else stale):
            break
    if report is not None:
        report.update(steps=steps, batches=batches, cost=smooth)
    return centers


def nearest_center(rows: DataFrame, centers: np.ndarray, name: str = "metacell") -> DataFrame:
    """cell_id and the number of the nearest centre, in one pass without a shuffle."""
    tree = CenterTree(centers)

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell_id": b["cell_id"], name: tree.nearest(np.stack(b["vec"].to_numpy()).astype(float))[0].astype(np.int32)})

    kind = rows.schema["cell_id"].dataType.simpleString()
    return complete(rows.select("cell_id", "vec")).mapInPandas(run, f"cell_id {kind}, {name} int")
