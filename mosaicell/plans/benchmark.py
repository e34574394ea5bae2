"""Benchmark runs of the multi-scale analysis: seconds, peak memory and labels by resolution."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .multiscale import MultiscaleAnalysis

#: Memory that Spark measures of an executor; the last two are there with spark.executor.processTreeMetrics.enabled.
METRICS = ("JVMHeapMemory", "JVMOffHeapMemory", "ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory")


def peak_memory(spark: SparkSession) -> dict[str, float]:
    """MB at the peak of the largest executor so far, by kind of memory."""
    peaks = dict.fromkeys(METRICS, 0.0)
    for executor in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)):
        found = executor.peakMemoryMetrics()
        if found.isDefined():
            for name in METRICS:
                peaks[name] = max(peaks[name], found.get().getMetricValue(name) / 2**20)
    return peaks


def peak_mb(spark: SparkSession) -> float:
    """The resident memory of JVM and Python workers at their peaks if it is measured, else that of the JVM's heaps."""
    m = peak_memory(spark)
    return m["ProcessTreeJVMRSSMemory"] + m["ProcessTreePythonRSSMemory"] or m["JVMHeapMemory"] + m["JVMOffHeapMemory"]


def run_resolutions(points: DataFrame, rep: DataFrame, resolutions: list[float], path: str, **parameters) -> DataFrame:
    """resolution, seconds, peak_mb, labels (their number over all titles): one whole analysis a
    resolution. Writes labels_res<r> (cell_id, a column a title) and the table itself as CSV under path.
    Peaks are the session's so far: start a session for each resolution to tell them apart."""
    spark, rows = points.sparkSession, []
    for r in resolutions:
        began = time.perf_counter()
        run = MultiscaleAnalysis(points, {"rep": rep})
        run.perform_multiscale_pipeline("rep", resolutions=[r], **parameters)
        titles = sorted(x[0] for x in run.labels.select("title").distinct().collect())
        wide = run.labels.groupBy("cell_id").pivot("title", titles).agg(F.first("label"))
        wide.withColumnsRenamed({t: t.replace(".", "_") for t in titles}).write.mode("overwrite").option("header", True).csv(f"{path}/labels_res{r}")
        seconds = time.perf_counter() - began
        rows.append((float(r), round(seconds, 3), round(peak_mb(spark), 1), run.labels.select("title", "label").distinct().count()))
    table = spark.createDataFrame(rows, "resolution double, seconds double, peak_mb double, labels long")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    return table
