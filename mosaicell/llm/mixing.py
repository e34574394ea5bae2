"""Mixing sources to target weights with hash-threshold histograms. DataFrame operations only.

Sizes are words. Each source gets a target by weight; a document is taken 0, 1 or 2 times:
``floor(target / source size)`` whole passes, and one more for the documents whose hash lies at
or below the source's threshold. The threshold is found without sorting documents: sizes are
summed by source and hash bucket, a running sum over the buckets finds the one in which the
budget ends, and only that bucket is divided again. Budgets are nested: a larger target takes a
superset of the documents that a smaller one takes, as the hash does not depend on the target.

Defined results: a null source is a source of its own, last in order; null or empty texts have
size 0, long ones count all their words; rows repeated with one doc_id share a hash and are taken alike; an empty table gives an
empty result; a source without words has target 0. Equal inputs give equal outputs in any order
of rows or partitions. `mix` adds its columns to the input's and replaces clashing ones; `resample`
keeps the input's columns alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, join_small, materialize

#: Bits of the hash, of which each histogram level reads LEVEL_BITS.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 2


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def id_hash(key, seed: str = "") -> F.Column:
    """60 bits of the md5 of the key as text, as a long."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: float, cap: float) -> DataFrame:
    """sizes(src, source, source_size) -> + target. One row a source.

    The total of epochs * all sizes is shared by weight; what exceeds cap * source_size is shared
    again among the others until none is above. In order of cap / weight the sources at their
    cap come first, so running sums give the level in one pass."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap_of = F.lit(cap) * F.col("source_size")
    out = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("double"))
        .withColumn("_ratio", cap_of / F.col("_w"))
        .withColumn("_total", F.lit(epochs) * F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum(cap_of).over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_full", cap_of <= F.col("_level") * F.col("_w"))
        .withColumn("_rank", F.row_number().over(by_ratio))
    )
    level = F.min(F.when(~F.col("_full"), F.struct("_rank", "_level"))).over(everything)["_level"]
    return out.withColumn("target", F.when(F.col("_full"), cap_of).otherwise(level * F.col("_w"))).select("src", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """sized(src, size, h), goals(src, source_size, target) -> src, source_size, target, passes, last.

    `last` is the greatest hash that gets one more copy, or -1. The documents of one hash belong
    to it as long as that brings the sum nearer to the budget."""
    state = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = state.withColumn("extra", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("done", F.lit(0).cast("long"))
    rows, edge = sized, state.select("src", "extra", "done")
    by_hash = Window.partitionBy("src").orderBy("part")
    for level in range(LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        part = F.col("h") if level == LEVELS else F.shiftright("h", shift)
        sums = rows.withColumn("part", part).groupBy("src", "part").agg(F.sum("size").alias("size"))
        sums = join_small(sums, edge.select("src", "extra", "done"), ["src"], "inner", n_sources)
        sums = sums.withColumn("after", F.col("done") + F.sum("size").over(by_hash)).withColumn("before", F.col("after") - F.col("size"))
        if level == LEVELS:
            found = sums.filter(F.col("before") + F.col("after") <= 2 * F.col("extra")).groupBy("src").agg(F.max("part").alias("in_bucket"))
            break
        # the bucket in which the sum first exceeds the budget; sources without one take every document
        edge = materialize(sums.filter(F.col("after") > F.col("extra")).groupBy("src", "extra").agg(F.min(F.struct("part", "before")).alias("m")).select("src", "extra", F.col("m.part").alias("part"), F.col("m.before").alias("done")), "mix-edge")
        rows = join_small(rows.withColumn("part", part), edge.select("src", "part"), ["src", "part"], "left_semi", n_sources)
    below = F.shiftleft(F.col("part"), HASH_BITS - LEVEL_BITS * LEVELS) - 1
    edge = edge.join(found, "src", "left").select("src", F.coalesce("in_bucket", below).alias("last"))
    every = F.lit((1 << HASH_BITS) - 1).cast("long")
    return state.join(edge, "src", "left").select("src", "source_size", "target", "passes", F.coalesce("last", every).alias("last"))


def _source_name(source) -> F.Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def cuts(docs: DataFrame, size, weights: tuple[int, ...], epochs: float, cap: float, seed: str, key: str, source: str) -> tuple[DataFrame, int]:
    """src, source_size, target, passes, last of each source, and their number. The text is read
    once, for `size`."""
    sized = docs.select(_source_name(F.col(source)).alias("src"), F.col(source).alias("source"), size.alias("size"), id_hash(F.col(key), seed).alias("h"))
    sized = materialize(sized, "mix-sizes")
    sizes = materialize(sized.groupBy("src", "source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = sizes.count()
    goals = materialize(targets(sizes, weights, epochs, cap), "mix-goals")
    return materialize(thresholds(sized.drop("source"), goals, n), "mix-cut"), n


def _copies(docs: DataFrame, cut: DataFrame, n: int, columns: dict[str, str], cap: float, seed: str, key: str, source: str) -> DataFrame:
    """docs with the number of copies of each row and the named columns of its source's cut."""
    src, h, passes, last = (free_name(docs, x) for x in ("mix_src", "mix_hash", "mix_passes", "mix_last"))
    rows = docs.withColumns({src: _source_name(F.col(source)), h: id_hash(F.col(key), seed)})
    names = {"src": src, "passes": passes, "last": last} | columns
    out = join_small(rows, cut.select(*[F.col(a).alias(b) for a, b in names.items() if a != "copies"]), [src], "inner", n)
    copies = F.least(F.col(passes) + (F.col(h) <= F.col(last)).cast("long"), F.lit(int(cap)).cast("long"))
    return out.withColumn(columns["copies"], copies).drop(src, h, passes, last)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5, cap: float = 2.0, seed: str = "", key: str = "doc_id", text: str = "text", source: str = "source", words: str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= copies * size).

    words: a column that has the sizes already; the text is then not read."""
    added = ["size", "source_size", "target", "copies", "taken"]
    size = F.col(words) if words else word_count(F.col(text))
    docs = docs.drop(*[c for c in added if c not in (key, text, source, words)]).withColumn("size", size)
    cut, n = cuts(docs, F.col("size"), weights, epochs, cap, seed, key, source)
    out = _copies(docs, cut, n, {x: x for x in ("source_size", "target", "copies")}, cap, seed, key, source)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def resample(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), epochs: float = 1.5, cap: float = 2.0, seed: str = "", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs alone."""
    cut, n = cuts(docs, word_count(F.col(text)), weights, epochs, cap, seed, key, source)
    copies = free_name(docs, "mix_copies")
    return expand(_copies(docs, cut, n, {"copies": copies}, cap, seed, key, source), copies).drop(copies)


def expand(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each document as often as it is taken."""
    one = free_name(mixed, "mix_copy")
    return mixed.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).drop(one)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0 * source_size AS cap,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level,
    row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS rank
  FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CAST(CASE WHEN cap <= level * w THEN cap
    ELSE min_by(level, rank) FILTER (WHERE cap > level * w) OVER () * w END AS DOUBLE) AS target
  FROM r
), g AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS after,
    sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(2, passes + CASE WHEN 2 * after - own <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g
"""
