"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

Documents are sets of distinct word 5-grams (64-bit hashes); documents with equal sets form a
class, represented by its smallest doc_id. Two sets x, y link when 9 |x & y| >= 4 (|x| + |y|),
which is similarity 0.8.

1. Survivors. In hash order, linked sets share at least l grams within their first
   |x| - ceil(0.8 |x|) + l grams. Grams of these prefixes that occur in two classes are counted
   for each class; classes with too few can't link with any other and are done.
2. Order. The survivors' grams get a global order: document frequency, then hash. It is cut into
   fragments of about equal mass, and each set into one segment a fragment. Grams of a single
   document are dropped, but stay part of the size.
3. Star pairs. Linked sets share a gram in their prefixes by this order. Each prefix gram's group
   of documents has a hub, and each member is compared with the hub alone: overlaps are counted in
   each fragment by itself and summed by pair.
4. Delta pairs. Two members x, r of one hub h that aren't both linked to h may link all the same.
   With D(x) the symmetric difference of x and h, |x ^ r| = |D(x)| + |D(r)| - 2 |D(x) & D(r)|, so
   they have to share enough of their differences; a prefix join on the rare grams of these small
   sets finds every such pair, and its overlap is counted by fragments again. Only pairs of two
   components of the star links matter: grams whose documents are all of one component are dropped,
   and of the others' documents only those outside the gram's largest component are compared with
   the rest.
5. Components, by the least label over links.

So a group of G near copies costs about G comparisons, not G * G / 2, as long as the stars join most
of it, and no link between two components is lost. Documents that share their differences from a
hub and are linked neither to it nor, by any hub, with each other are compared in pairs. Links
within a component may go unlisted: `links` has enough of them to connect each component.

Defined results: null texts and texts without words have an empty set and link with nothing;
fewer words than a gram form one gram; repeated rows and copies share a class; rows with a null
doc_id get the component of their class, or null if it has no doc_id; an empty table gives an
empty result; further columns are ignored. Similarity of exactly the threshold links; texts of any
length enter with all their grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, remove, slices

N = 5
FRAGMENTS = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sets


def gram_set(text: bytes | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams. bytes.lower and bytes.split know ASCII only."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(n, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out *= _MULTIPLIER
        out += h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _MULTIPLIER
    return np.unique(out ^ (out >> np.uint64(29)) ^ np.uint64(size))


def need(size):
    """Least overlap of a set of this size with a linked one that is no smaller."""
    return -(-4 * size // 5)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sliced(batches):
    for batch in batches:
        for start, length in slices(batch.column("text")):
            yield batch.slice(start, length)


def _profiles(n: int):
    """Of each document: the set's size, a 128-bit fingerprint and the prefix in hash order."""

    def run(batches):
        for batch in _sliced(batches):
            sets = [gram_set(t, n) for t in batch.column("text").to_pylist()]
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            sizes = np.array([len(s) for s in sets], np.int64)
            tops = sizes - need(sizes) + 1 + sizes // 25
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _lists([s[:t] if len(s) else s for s, t in zip(sets, tops.tolist(), strict=True)])],
                ["doc_id", "n", "f1", "f2", "prefix"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for batch in _sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists([gram_set(t, n) for t in batch.column("text").to_pylist()])], ["doc_id", "grams"])

    return run


# ---------------------------------------------------------------- join


def _overlaps(pairs: DataFrame, segments: DataFrame, deltas: bool) -> DataFrame:
    """pairs(a, b) -> shared; with deltas also the grams of one side alone, tagged by side.

    Each fragment of a pair is counted by itself; the counts are summed by pair."""
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left = segments.select(F.col("doc").alias("a"), "part", F.col("grams").alias("ga"))
    right = segments.select(F.col("doc").alias("b"), "part", F.col("grams").alias("gb"))
    none = F.array().cast("array<bigint>")
    both = each.join(left.hint("merge"), ["a", "part"], "left").join(right.hint("merge"), ["b", "part"], "left")
    ga, gb = F.coalesce("ga", none), F.coalesce("gb", none)
    out = [F.sum(F.size(F.array_intersect(ga, gb))).cast("long").alias("shared")]
    if deltas:
        out += [F.flatten(F.collect_list(F.array_except(ga, gb))).alias("only_a"), F.flatten(F.collect_list(F.array_except(gb, ga))).alias("only_b")]
    return both.groupBy("a", "b").agg(*out)


def _linked(shared, a, b) -> F.Column:
    return 9 * shared >= 4 * (a + b)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component: the least node reachable. Labels spread over the edges and
    jump to the label of their label until none changes."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        best = labels.join(near.hint("merge"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = materialize(best.join(jump.hint("merge"), "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        changed = new.filter(F.col("old") != F.col("component")).limit(1).count()
        remove(new.sparkSession, labels)
        labels = new.drop("old")
        if not changed:
            remove(new.sparkSession, both)
            return labels


def jaccard_classes(docs: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """profiles(doc_id, n, f1, f2), links(a, b, shared) between classes, groups(node, component).

    docs(doc_id, text). Nodes are classes, named by their smallest doc_id."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    spark = docs.sparkSession
    full = materialize(source.mapInArrow(_profiles(n), "doc_id long, n long, f1 long, f2 long, prefix array<long>"), "profiles-full")
    profiles = materialize(full.select("doc_id", "n", "f1", "f2"), "profiles")
    nodes = profiles.filter("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc"))

    # survivors: one row of prefix grams for each class
    named = nodes.select("doc", F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    firsts = full.filter("n > 0").join(named.hint("merge"), F.col("doc_id") == F.col("doc")).filter("f1 = g1 AND f2 = g2")
    prefixes = materialize(firsts.groupBy("doc").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "prefixes")
    remove(spark, full)
    rows = prefixes.select("doc", F.explode("prefix").alias("gram"))
    common = materialize(rows.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1").select("gram"), "common")
    hits = materialize(rows.join(common.hint("merge"), "gram", "left_semi").groupBy("doc").agg(F.count("*").alias("hits")), "hits")
    needed = 1 + F.floor(F.ceil(F.col("n") * 4 / 5) / 25)
    survivors = materialize(hits.join(prefixes.select("doc", "n").hint("merge"), "doc").filter(F.col("hits") >= needed).select("doc", "n"), "survivors")
    for used in (prefixes, common, hits):
        remove(spark, used)

    # global order over the survivors' grams
    texts = source.join(survivors.hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi")
    sets = texts.mapInArrow(_sets(n), "doc_id long, grams array<long>").groupBy("doc_id").agg(F.first("grams").alias("grams"))
    sets = materialize(sets.select(F.col("doc_id").alias("doc"), "grams"), "sets")
    grams = sets.select("doc", F.explode("grams").alias("gram"))
    df = materialize(grams.groupBy("gram").agg(F.count("*").cast("int").alias("df")).filter("df > 1"), "frequencies")
    ranked = grams.join(df.hint("merge"), "gram").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("ranked"))
    ordered = materialize(ranked.join(survivors.hint("merge"), "doc").filter(F.size("ranked") >= F.ceil(F.col("n") * 4 / 5)), "ordered")
    for used in (sets, df):
        remove(spark, used)
    mass = ordered.select(F.explode("ranked.df").alias("df")).agg(F.percentile_approx("df", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000)).first()[0] or []
    cuts = sorted(set(mass))
    # fragments by frequency; a frequency that holds several fragments' mass is cut by hash
    part = _fragment(cuts, mass)
    segments = ordered.select("doc", F.explode("ranked").alias("r")).groupBy("doc", part.alias("part")).agg(F.collect_list("r.gram").alias("grams"))
    segments = materialize(segments, "segments")
    sizes = ordered.select("doc", "n", F.size("ranked").alias("m"))

    # star pairs
    top = F.col("m") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1
    heads = ordered.withColumn("m", F.size("ranked")).select("doc", "n", "m", F.explode(F.slice("ranked", F.lit(1), top)).alias("r")).select("doc", "n", "m", "r.gram")
    heads = materialize(heads, "heads")
    hubs = heads.groupBy("gram").agg(F.min(F.struct(F.col("n") - F.col("m"), F.col("doc"))).alias("hub"), F.count("*").alias("df")).filter("df > 1").select("gram", F.col("hub.doc").alias("a"))
    hubs = materialize(hubs, "hubs")  # a join right below its own aggregation could not split a hot gram
    stars = heads.select("gram", F.col("doc").alias("b")).join(hubs.hint("merge"), "gram").filter("a <> b").select("a", "b").distinct()
    stars = _overlaps(stars, segments, deltas=True)
    by_a, by_b = (sizes.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("m").alias(f"m{c}")) for c in "ab")
    stars = materialize(stars.join(by_a.hint("merge"), "a").join(by_b.hint("merge"), "b").withColumn("linked", _linked(F.col("shared"), F.col("na"), F.col("nb"))), "stars")
    links = stars.filter("linked").select("a", "b", "shared")

    # delta pairs: ninefold sizes keep the sums whole
    known = components(links) if links.limit(1).count() else spark.createDataFrame([], "node long, component long")
    deltas = stars.select(
        F.col("a").alias("hub"), F.col("b").alias("doc"), "linked", F.col("nb").alias("n"),
        (9 * (F.col("na") + F.col("nb") - 2 * F.col("shared")) - F.col("nb") - 9 * (F.col("na") - F.col("ma"))).alias("e9"),
        (F.col("na") - 9 * (F.col("na") - F.col("ma"))).alias("free9"),
        F.concat(F.transform("only_a", lambda g: F.struct(F.lit(0).alias("side"), g.alias("gram"))), F.transform("only_b", lambda g: F.struct(F.lit(1).alias("side"), g.alias("gram")))).alias("delta"),
    )
    # comp and home: the star components of the document and of its hub
    for of, name in (("doc", "comp"), ("hub", "home")):
        deltas = deltas.join(known.select(F.col("node").alias(of), F.col("component").alias(name)).hint("merge"), of, "left").withColumn(name, F.coalesce(name, of))
    deltas = materialize(deltas, "deltas")
    own = ["hub", "doc", "comp", "linked", "n", "e9", "free9"]
    tokens = deltas.select(*own, F.explode("delta").alias("d")).select(*own, "d.side", "d.gram")
    key = ["hub", "side", "gram"]
    counted = tokens.groupBy(*key, "comp").agg(F.count("*").alias("n"), F.sum((~F.col("linked")).cast("int")).alias("open"))
    local = counted.groupBy(*key).agg(F.sum("n").alias("df"), F.sum("open").alias("open"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
    local = materialize(local.filter("comps > 1 AND open > 0").select(*key, "df", F.col("top.comp").alias("major")), "local")
    ranked = tokens.join(local.hint("merge"), key).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("df", "side", "gram", "major"))).alias("ranked"))
    # what any partner that isn't linked to the hub asks for, at least; an unlinked one asks for
    # e - |partner| / 9 too, with a partner of at most 1.25 times the size
    least = F.ceil((F.col("e9") + F.col("free9") + 1) / 18)
    least = F.greatest(F.lit(1), F.when(F.col("linked"), least).otherwise(F.ceil((F.col("e9") - F.col("n") * 5 / 4) / 9)))
    chosen = ranked.withColumn("top", F.size("ranked") - least.cast("int") + 1).filter("top > 0")
    chosen = chosen.select("hub", "doc", "comp", "linked", "e9", F.size("ranked").alias("size"), F.posexplode(F.slice("ranked", F.lit(1), F.col("top"))).alias("at", "d"))
    chosen = materialize(chosen.select("hub", "doc", "comp", "linked", "e9", (F.col("size") - F.col("at")).alias("rest"), "d.side", "d.gram", "d.major"), "chosen")
    side = lambda s: [F.col(c).alias(f"{c}{s}") for c in ("comp", "linked", "e9", "rest")]
    minor = chosen.filter("comp <> major").select(*key, F.col("doc").alias("b"), *side("b"))
    every = chosen.select(*key, F.col("doc").alias("a"), (F.col("comp") == F.col("major")).alias("major"), *side("a"))
    # at its first common gram a pair that links has as many grams left as it must share; two that
    # are both outside the largest component meet once
    met = every.join(minor.hint("merge"), key).filter("compa <> compb AND NOT (linkeda AND linkedb) AND (major OR a < b) AND 18 * resta >= e9a + e9b AND 18 * restb >= e9a + e9b").select("a", "b")
    # pairs that may link without sharing any difference
    loose = deltas.filter(F.col("e9") + F.col("free9") < 0).select("hub", F.col("doc").alias("a"), F.col("comp").alias("compa"), F.col("e9").alias("ea"), "linked")
    open_ones = deltas.filter("NOT linked").select("hub", F.col("doc").alias("b"), F.col("comp").alias("compb"), F.col("e9").alias("eb"), "home")
    for some, others in ((loose.filter("linked"), open_ones.filter("compb <> home")), (loose.filter("NOT linked"), open_ones)):
        met = met.unionByName(some.drop("linked").join(others.drop("home").hint("merge"), "hub").filter("compa <> compb AND ea + eb <= 0").select("a", "b"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = met.join(by_a.hint("merge"), "a").join(by_b.hint("merge"), "b").filter("5 * na >= 4 * nb AND 5 * nb >= 4 * na")
    met = materialize(met, "met")
    more = _overlaps(met.select("a", "b"), segments, deltas=False).join(met.select("a", "b", "na", "nb").hint("merge"), ["a", "b"]).filter(_linked(F.col("shared"), F.col("na"), F.col("nb")))
    links = materialize(links.unionByName(more.select("a", "b", "shared")), "links")
    groups = components(links)
    return profiles, links, groups


def _fragment(cuts: list[int], mass: list[int]) -> F.Column:
    """Fragment of r(df, gram): intervals of df between cuts; equal cuts share a df by hash."""
    if not mass:
        return F.lit(0)
    df, gram = F.col("r.df"), F.col("r.gram")
    out = F.lit(len([m for m in mass if m <= cuts[-1]]))
    for c in reversed(cuts):
        first, held = mass.index(c), mass.count(c)
        within = F.lit(first) if held == 1 else F.lit(first) + F.pmod(F.shiftright(gram, 8), F.lit(held)).cast("int")
        out = F.when(df < c, F.lit(first)).when(df == c, within).otherwise(out)
    return out


def label(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    profiles, _, groups = jaccard_classes(docs, n)
    return _labels(profiles, groups)


def _labels(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    classes = profiles.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"))
    classes = classes.join(groups.hint("merge"), "node", "left").select("f1", "f2", "n", F.coalesce("component", "node").alias("component_id"))
    out = profiles.join(classes.hint("merge"), ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = N) -> DataFrame:
    """One row of each component: a row of its smallest doc_id. Rows without doc_id or words stay."""
    dropped = free_name(docs, "near_copy")
    labels = label(docs, n).filter("component_id <> doc_id").select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(labels.hint("merge"), F.col("doc_id").cast("long") == F.col(dropped), "left_anti")
