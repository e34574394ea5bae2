"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records uniformly, by a seeded hash of key and text, into buckets small
enough for memory. Pass 2 sorts each bucket canonically (by key, then a hash of all columns; a
sort of the JVM, which spills), permutes its places by Fisher-Yates with a seed of the bucket's
own and writes its records in the new order. A running sum of the bucket counts turns the place
in the bucket into a global place g; the record goes to shard ``g mod n`` at slot ``g div n``. So
shard counts are at most one apart (law `rows`) and slots are gapless.

A permutation depends on the bucket's number and count alone, so Python workers see one short row
a bucket and no records; the records' only shuffle is the scatter.

A lost executor's tasks recompute the same order: it depends on contents and seed alone.

Defined results: null keys and texts are hashed as null; rows that are equal in key and text share
a bucket, and those equal in all columns are interchangeable; an empty table gives an empty
result; empty texts are records like others, and a text longer than a bucket makes its bucket that long; input columns that clash with the added `shard` and `slot` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, utf8_size

SHARDS = 24
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 256
#: Buckets share tasks of about TASK_BYTES, so that small tables don't make hundreds of files.
TASK_BYTES, MIN_TASKS = 32 << 20, 16
#: Buckets whose counts are summed in one task; the sums of blocks are added up in another.
BLOCK = 4096


def fisher_yates(n: int, seed: tuple[int, ...]) -> list[int]:
    """A uniform permutation of range(n)."""
    order = list(range(n))
    if n > 1:
        tops = np.arange(n - 1, 0, -1)
        for i, j in zip(tops.tolist(), np.random.default_rng(seed).integers(0, tops + 1).tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def _orders(seed: int):
    """bucket, n, before -> bucket, before and the new place of each of the bucket's n records."""

    def run(batches):
        for batch in batches:
            for bucket, n, before in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "before")), strict=True):
                order = pa.array([fisher_yates(n, (seed, bucket))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([before], pa.int64()), order], ["bucket", "before", "order"])

    return run


def offsets(counts: DataFrame) -> DataFrame:
    """counts(bucket, n) -> + before: the records of all lower buckets, summed by block."""
    lower = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(lower(w)), F.lit(0))
    placed = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK)).withColumn("own", sum_of("n", Window.partitionBy("block").orderBy("bucket")))
    blocks = placed.groupBy("block").agg(F.sum("n").alias("total"))
    blocks = blocks.withColumn("base", sum_of("total", Window.orderBy("block"))).select("block", "base")
    return placed.join(blocks, "block").select("bucket", "n", (F.col("base") + F.col("own")).cast("long").alias("before"))


def external_shuffle(df: DataFrame, shards: int = SHARDS, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with shard and slot; the rows of a bucket come out in their new order."""
    df = df.drop("shard", "slot")
    bucket, tie, rank, place, before, order = (free_name(df, f"shuffle_{x}") for x in ("bucket", "tie", "rank", "place", "before", "order"))
    total = df.agg(F.sum(utf8_size(F.col(text)) + 64)).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    tasks = max(MIN_TASKS, -(-total // TASK_BYTES))  # in proportion to the records, whatever the session's number of shuffle partitions
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(buckets)).cast("int"))
    counts = materialize(dealt.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n")), "shuffle-counts")
    orders = offsets(counts).repartition(tasks, "bucket").mapInArrow(_orders(seed), "bucket int, before long, order array<int>")
    orders = orders.withColumnsRenamed({"bucket": bucket, "before": before, "order": order})
    columns = [c for c, kind in df.dtypes if "map<" not in kind]  # maps have no order; all else breaks ties
    keyed = dealt.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    canonical = Window.partitionBy(bucket).orderBy(key, tie)
    ranked = keyed.repartition(tasks, bucket).withColumn(rank, F.row_number().over(canonical))
    placed = ranked.join(orders.hint("merge"), bucket).withColumn(place, F.col(before) + F.col(order)[F.col(rank) - 1]).drop(order, tie, rank, before)
    placed = placed.sortWithinPartitions(bucket, place)
    return placed.select(*[f"`{n}`" for n in df.columns], (F.col(place) % shards).cast("int").alias("shard"), F.floor(F.col(place) / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its files in order of slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    size = utf8_size(F.col("text")) + 8
    return sharded.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
