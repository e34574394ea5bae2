"""Copies among media columns by local image descriptors.

An image is an 8-bit binary PGM (P5). On each level of a halving pyramid, corners are the local
maxima of the Harris response; a corner's orientation is that of its patch's intensity centroid,
and 128 intensity comparisons, rotated to it, make the descriptor. Equal bytes are collapsed to
one representative first. Representatives meet in three Hamming tables, one for each 42 bits of
the descriptor (any two descriptors within 2 bits meet, many within 10 do, and one of an image's
corners is enough); two images with a word in common whose descriptors are within MEET_BITS are a
candidate pair. Then all corners of the two
are compared: descriptors within MAX_BITS vote for the scale, rotation and shift that map one image
to the other, in two shifted grids, and MIN_INLIERS votes for one transformation, and MIN_SHARE of
the smaller image's corners, link the images. So crops, scaled by two or rotated copies and edits
of a part are found as long as enough corners survive.

All corners take part. An entry's hub is the least of its images, and each image is first compared
with the hub that it meets most often alone; then images of different components meet in pairs,
those of an entry's largest component only with the others.
So a group of G copies costs about G comparisons, and no link between two classes is lost; links
within a class may go unlisted. Images that share a word and no link are compared in pairs. Each
image gets the least id of its component.

Defined results: null or unreadable media have no corners and link with equal bytes only; flat
images likewise; pictures of any size are described whole, one at a time; of hubs that an image meets
equally often the least counts; a null id is kept and gets a null class; repeated rows share the class; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .ngram_join import components

LEVELS, RADIUS, BITS, ANGLES = 2, 9, 128, 32
#: Pixels by which the two points of a test may differ along the corner's direction, and must differ across it.
ALONG, ACROSS = 3, 4
RELATIVE_RESPONSE = 0.02
#: Bits of a word of the Hamming tables; 3 * WORD are at most BITS.
WORD = 42
#: Bits in which descriptors differ that propose a pair (a word is equal, so true ones are near), and that fit.
MEET_BITS, MAX_BITS = 16, 32
MIN_INLIERS, MIN_SHARE, GRID = 4, 0.15, 6
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_pgm(media: bytes | None) -> np.ndarray | None:
    head = _HEADER.match(media or b"")
    if not head:
        return None
    w, h = int(head[1]), int(head[2])
    body = media[head.end() : head.end() + w * h]
    return np.frombuffer(body, np.uint8).reshape(h, w) if len(body) == w * h > 0 else None


def _pattern() -> np.ndarray:
    """ANGLES x BITS x 2 points x (dy, dx): one random pattern, turned to each angle.

    The points of a test lie beside each other, seen along the corner's direction: brightness rises
    that way in every patch, so a test along it would come out alike for most corners."""
    rng, tests = np.random.default_rng(12), []
    while len(tests) < BITS:
        one, two = rng.integers(1 - RADIUS, RADIUS, (2, 2))
        if max(one @ one, two @ two) <= (RADIUS - 1) ** 2 and abs(one[1] - two[1]) <= ALONG and abs(one[0] - two[0]) >= ACROSS:
            tests.append((one, two))
    points = np.array(tests, float)
    turn = np.arange(ANGLES) * 2 * np.pi / ANGLES
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    y, x = points[None, ..., 0], points[None, ..., 1]
    return np.rint(np.stack([s * x + c * y, c * x - s * y], -1)).astype(np.int64)


PATTERN = _pattern()
_DISC = np.array([(y, x) for y in range(1 - RADIUS, RADIUS) for x in range(1 - RADIUS, RADIUS) if y * y + x * x <= (RADIUS - 1) ** 2])


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        p = np.pad(x, pad, "edge")
        n = x.shape[axis]
        part = lambda k: p[:, k : k + n] if axis == 1 else p[:, :, k : k + n]  # noqa: B023, E731
        x = (part(0) + part(4) + 4 * (part(1) + part(3)) + 6 * part(2)) / 16
    return x


def describe(stack: np.ndarray):
    """Corners of same-sized images: image, x, y (on the first level), level, angle, bits as two longs."""
    found, x = [], stack.astype(np.float32)
    for level in range(LEVELS):
        h, w = x.shape[1:]
        if min(h, w) <= 2 * RADIUS + 2:
            break
        soft = _blur(x)
        gy, gx = np.gradient(soft, axis=(1, 2))
        a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
        r = a * c - b * b - 0.04 * (a + c) ** 2
        peak = r > RELATIVE_RESPONSE * np.maximum(r.max((1, 2), keepdims=True), 1e-3)
        mid = r[:, 1:-1, 1:-1]
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    near = r[:, dy : dy + h - 2, dx : dx + w - 2]
                    peak[:, 1:-1, 1:-1] &= mid > near if (dy, dx) < (1, 1) else mid >= near
        peak[:, :RADIUS] = peak[:, -RADIUS:] = False
        peak[:, :, :RADIUS] = peak[:, :, -RADIUS:] = False
        n, ys, xs = np.nonzero(peak)
        patch = soft[n[:, None], ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
        angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
        turn = np.rint(angle * ANGLES / (2 * np.pi)).astype(np.int64) % ANGLES
        at = PATTERN[turn]
        one = soft[n[:, None], ys[:, None] + at[:, :, 0, 0], xs[:, None] + at[:, :, 0, 1]]
        two = soft[n[:, None], ys[:, None] + at[:, :, 1, 0], xs[:, None] + at[:, :, 1, 1]]
        words = np.packbits(one < two, axis=1).view(np.int64).reshape(-1, 2)
        found.append((n, xs << level, ys << level, np.full(len(n), level), turn, words[:, 0], words[:, 1]))
        x = (x[:, : h // 2 * 2, : w // 2 * 2].reshape(len(x), h // 2, 2, w // 2, 2)).mean((2, 4))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 7


def _corners(batches):
    """node, and of its corners d1, d2 and their place: x, y, level and angle in one long."""
    for batch in batches:
        ids, media = batch.column("node"), batch.column("media")
        for start, length in slices(media, 1 << 19):
            shapes: dict[tuple, list[int]] = {}
            images = [decode_pgm(m) for m in media.slice(start, length).to_pylist()]
            for k, image in enumerate(images):
                if image is not None:
                    shapes.setdefault(image.shape, []).append(k)
            for own in shapes.values():
                n, x, y, level, angle, d1, d2 = describe(np.stack([images[k] for k in own]))
                place = (x << 36) + (y << 12) + (level << 6) + angle
                order = np.argsort(n, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(n, minlength=len(own)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c[order].astype(np.int64))) for c in (d1, d2, place)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + np.array(own, np.int64))), *lists], ["node", "d1", "d2", "place"])


CORNERS = "node long, d1 array<long>, d2 array<long>, place array<long>"
_PLACE = ((36, 24), (12, 24), (6, 6), (0, 6))


def _votes(p: np.ndarray, q: np.ndarray, pair: np.ndarray, own: np.ndarray, pairs: int) -> np.ndarray:
    """Of each pair, the most corners that agree on one way from p to q (rows x, y, level, angle)."""
    turn = (q[3] - p[3]) % ANGLES
    # copies are mostly upright or turned by a right angle; one step aside is noise of the angle
    quarter = (turn + 1) // (ANGLES // 4) * (ANGLES // 4)
    turn = np.where(abs(turn - quarter) <= 1, quarter, turn) % ANGLES
    angle, scale = turn * (2 * np.pi / ANGLES), 2.0 ** (q[2] - p[2])
    dx = q[0] - scale * (np.cos(angle) * p[0] - np.sin(angle) * p[1])
    dy = q[1] - scale * (np.sin(angle) * p[0] + np.cos(angle) * p[1])
    best = np.zeros(pairs, np.int64)
    for shift in (0.0, 0.5):
        cell = [pair, q[2] - p[2], np.floor(turn / 4 + shift), np.floor(dx / GRID + shift), np.floor(dy / GRID + shift)]
        # a corner has one vote in a cell, however many corners of the other image it fits
        votes = np.unique(np.stack([*cell, own], 1).astype(np.int64), axis=0)
        cells, counts = np.unique(votes[:, :-1], axis=0, return_counts=True)
        np.maximum.at(best, cells[:, 0], counts)
    return best


def _verify(batches):
    """a, b and their corners -> the pairs whose corners agree on a transformation."""
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
        own = {}
        for c in ("d1", "d2", "place"):
            for s in "ab":
                col = batch.column(f"{c}{s}")
                own[c, s] = (col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())]))
        sizes = {s: np.diff(own["d1", s][1]) for s in "ab"}
        found: list[list[np.ndarray]] = [[], [], []]
        for k in range(len(batch)):
            part = {key: values[ends[k] : ends[k + 1]] for key, (values, ends) in own.items()}
            apart = sum(np.bitwise_count(part[d, "a"][:, None] ^ part[d, "b"][None]).astype(np.int16) for d in ("d1", "d2"))
            i, j = np.nonzero(apart <= MAX_BITS)
            for out, x in zip(found, (np.full(len(i), k), i + own["d1", "a"][1][k], j + own["d1", "b"][1][k]), strict=True):
                out.append(x)
        pair, i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        p, q = (np.stack([(own["place", s][0][at] >> shift) & ((1 << bits) - 1) for shift, bits in _PLACE]) for s, at in (("a", i), ("b", j)))
        best = np.maximum(_votes(p, q, pair, i, len(batch)), _votes(q, p, pair, j, len(batch)))
        good = pa.array((best >= MIN_INLIERS) & (best >= MIN_SHARE * np.minimum(sizes["a"], sizes["b"])))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


def links(corners: DataFrame) -> DataFrame:
    """corners(node, d1, d2, place) -> a, b of linked images, a < b; enough to connect each component."""
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    d1, d2 = F.col("c.d1"), F.col("c.d2")
    bands = F.array(low(d1, WORD), F.shiftrightunsigned(d1, WORD) + F.shiftleft(low(d2, 2 * WORD - 64), 64 - WORD), low(F.shiftrightunsigned(d2, 2 * WORD - 64), WORD))
    each = corners.select("node", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "c"))
    words = each.select("node", "at", F.posexplode(bands).alias("band", "word"))
    words = words.select((F.shiftleft(F.col("band").cast("long"), WORD) + F.col("word")).alias("key"), "node", "at")
    # a word of one image only meets nothing; all images of the others meet each other
    several = words.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key")
    shared = materialize(words.join(several.hint("merge"), "key", "left_semi"), "media-words")
    shared = shared.join(corners.select("node", "d1", "d2").hint("merge"), "node").select("key", "node", F.col("d1")[F.col("at")].alias("d1"), F.col("d2")[F.col("at")].alias("d2"))
    shared = materialize(shared, "media-described")
    apart = lambda s, t: F.bit_count(F.col(f"d1{s}").bitwiseXOR(F.col(f"d1{t}"))) + F.bit_count(F.col(f"d2{s}").bitwiseXOR(F.col(f"d2{t}")))
    side = lambda df, s, *more: df.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("node", "d1", "d2", *more)])
    hubs = shared.groupBy("key").agg(F.min(F.struct("node", "d1", "d2")).alias("hub")).select("key", "hub.*")
    hubs = materialize(hubs, "media-hubs")  # a join right below its own aggregation could not split a hot word
    met = side(shared, "b").join(side(hubs, "a").hint("merge"), "key").filter((F.col("nodea") != F.col("nodeb")) & (apart("a", "b") <= MEET_BITS))
    votes = met.groupBy("nodeb", "nodea").agg(F.count("*").alias("n"))
    met = votes.groupBy("nodeb").agg(F.max(F.struct("n", (-F.col("nodea")).alias("least"))).alias("top")).select((-F.col("top.least")).alias("nodea"), "nodeb")
    stars = materialize(_linked(met, corners), "media-stars")
    # what the stars leave apart
    known = components(stars)
    placed = shared.join(known.withColumnRenamed("component", "comp").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed.select("key", "node", "d1", "d2", "comp"), "media-placed")
    local = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
    local = materialize(local.filter("comps > 1").select("key", F.col("top.comp").alias("major")), "media-open")
    placed = placed.join(local.hint("merge"), "key").withColumn("inner", F.col("comp") == F.col("major"))
    met = side(placed, "a", "comp", "inner").join(side(placed.filter("NOT inner"), "b", "comp").hint("merge"), "key")
    met = met.filter((F.col("compa") != F.col("compb")) & (F.col("innera") | (F.col("nodea") < F.col("nodeb"))) & (apart("a", "b") <= MEET_BITS))
    return stars.unionByName(_linked(met, corners)).distinct()


def _linked(met: DataFrame, corners: DataFrame) -> DataFrame:
    """met(nodea, nodeb) -> a, b of those that are linked, a < b."""
    pairs = met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()
    for s in "ab":
        pairs = pairs.join(corners.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("d1", "d2", "place")]).hint("merge"), s)
    return pairs.mapInArrow(_verify, "a long, b long")


def copies(media: DataFrame) -> DataFrame:
    """media(id, media BINARY) -> id, class_id, class_size (rows), n_corners."""
    rows = media.select(F.col("id").cast("long"), F.sha2("media", 256).alias("digest"), "media")
    firsts = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("rows"))
    unique = rows.join(firsts.filter("node IS NOT NULL").select("node", F.col("digest").alias("own")).hint("merge"), (F.col("id") == F.col("node")) & (F.col("digest") == F.col("own")))
    unique = unique.groupBy("node").agg(F.first("media").alias("media"))
    corners = materialize(unique.mapInArrow(_corners, CORNERS), "media-corners")
    groups = components(materialize(links(corners), "media-links"))
    classes = firsts.join(groups.hint("merge"), "node", "left").withColumn("class_id", F.coalesce("component", "node"))
    classes = materialize(classes.join(corners.select("node", F.size("d1").alias("n_corners")).hint("merge"), "node", "left").select("digest", "class_id", "rows", "n_corners"), "media-classes")
    sizes = materialize(classes.groupBy(F.col("class_id").alias("own")).agg(F.sum("rows").alias("class_size")), "media-sizes")
    classes = classes.join(sizes.hint("merge"), F.col("class_id").eqNullSafe(F.col("own")), "left").drop("own", "rows")
    out = rows.select("id", "digest").join(classes.hint("merge"), "digest", "left")
    one = lambda c, other: F.coalesce(c, F.lit(other)).cast("long").alias(c)
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), one("class_size", 1), one("n_corners", 0))


#: Rendering of vectors: the side of a picture, and the grey levels of one standard deviation.
SIDE, CONTRAST = 56, 40
_textures: dict[int, np.ndarray] = {}


def _textures_of(n: int) -> np.ndarray:
    """n fixed textures of SIDE * SIDE pixels, each from a seed of its own; kept for one n."""
    if n not in _textures:
        _textures.clear()
        noise = np.stack([np.random.default_rng((9, k)).normal(0, 1, (SIDE + 2, SIDE + 2)) for k in range(n)])
        x = (noise[:, :-2] + noise[:, 1:-1] + noise[:, 2:]) / 3
        x = (x[:, :, :-2] + x[:, :, 1:-1] + x[:, :, 2:]) / 3
        x -= x.mean((1, 2), keepdims=True)
        _textures[n] = (x / x.std((1, 2), keepdims=True)).reshape(n, -1).astype(np.float32)
    return _textures[n]


def draw(vector) -> bytes | None:
    """The sum of the textures, each as strong as the vector's value for it: pictures correlate as
    their vectors do. None for a null or empty vector and for one with a value that is no number."""
    v = np.array([np.nan if x is None else x for x in (() if vector is None else vector)], np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    size = np.abs(v).max()
    v = v / size if size else v
    v = v / (np.linalg.norm(v) or 1.0)
    return encode_pgm(np.rint(np.clip(128 + CONTRAST * (v.astype(np.float32) @ _textures_of(len(v))), 0, 255)).reshape(SIDE, SIDE))


def _render(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([draw(v) for v in batch.column("vector").to_pylist()], pa.binary())], ["id", "media"])


def render_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(id, vector) -> id, media: each vector as a picture."""
    return vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(_render, "id long, media binary")
