"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A table with at most this many narrow rows may be broadcast (about 6 MB).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local runs."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="mosaicell-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of an execution go when it ends; without it they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes = threading.Lock()
_open: dict[object, list] = {}


@contextmanager
def cleanup(spark: SparkSession):
    """CLEANUP is on while any write of the session runs; the last one puts the setting back."""
    session = spark._jsparkSession.sessionUUID()
    with _writes:
        if session not in _open:
            _open[session] = [0, spark.conf.get(CLEANUP, None)]
            spark.conf.set(CLEANUP, "true")
        _open[session][0] += 1
    try:
        yield
    finally:
        with _writes:
            _open[session][0] -= 1
            if not _open[session][0]:
                _, before = _open.pop(session)
                if before is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. What was shuffled for the write
    is then of no more use and is deleted."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: UTF-8 bytes of text that a worker holds as Python objects at a time, if no single text is longer.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Yields (start, length) of runs of at most `most` bytes or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end - start
        start = end


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join a table of `rows` counted rows: broadcast if they are few, else a shuffled join that
    adaptive execution splits where a key is hot."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge"), on, how)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8_size(text) -> "F.Column":
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
