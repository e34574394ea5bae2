"""Readers, writers and adapters to the logical tables.

points(cell_id, x, y, label, vec), expression(cell_id, gene, value), edges(src, dst, weight),
signals(cell_id, scale_idx, scale, vec), seed_profiles(seed_id, round, nbr_id, distance, scale,
intensity). Everything an array container would hold is one of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests and sampling rounds: CSV with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema)


def read_h5ad(spark: SparkSession, path: str, layer: str | None = None, reps: tuple[str, ...] = (), columns: tuple[str, ...] = (), **options) -> dict[str, DataFrame]:
    """expression, points, rep_<name> and obs_<column> of an annotated HDF5 matrix, each read by ranges
    of rows in tasks of their own (sources/h5ad.py). Needs h5py on all machines."""
    from .h5ad import H5adSource, h5, layout, matrix

    with h5().File(path, "r") as f:
        by_column = layout(matrix(f, layer)) == "csc"
    spark.dataSource.register(H5adSource)

    def load(name: str, **more) -> DataFrame:
        return spark.read.format("h5ad").options(table=name, **options, **more).load(path)

    which = {"layer": layer} if layer else {}
    if by_column:  # a range of genes meets any cell
        expression = load("entries", **which).join(load("cells"), "pos").select("cell_id", "gene", "value")
    else:
        expression = load("expression", **which)
    out = {"expression": expression, "points": load("points")}
    out |= {f"rep_{r}": load("rep", rep=r) for r in reps}
    return out | {f"obs_{c}": load("obs", column=c) for c in columns}


def subsample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones each time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


# ------------------------------------------------------------------ sinks


def write_signals(signals: DataFrame, path: str) -> None:
    """One folder a scale, so that a filter on scale_idx reads only its files."""
    signals.write.mode("overwrite").partitionBy("scale_idx").parquet(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Metacells by title, seed profiles by round, heatmaps by group."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


#: Rows of a file of profile blocks, at most: a reader may hold all of them.
FILE_BLOCKS = 8


def write_profile_blocks(blocks: DataFrame, path: str) -> None:
    """mapping.profile_blocks by round, for `read_profiles`."""
    blocks.write.mode("overwrite").option("maxRecordsPerFile", FILE_BLOCKS).partitionBy("round").parquet(f"{path}/seed_profiles")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_mapping(tables: dict[str, DataFrame], path: str) -> None:
    """What mapping.map_scales_to_distance gives: rounds and manifest as CSV, profiles as Parquet by
    round, and the heatmap (a row a scale, a column a distance) and distances as CSV by group and as
    tables."""
    from ..operators.mapping import wide_heatmap

    write_csv(tables["rounds"].select("round", "cell_id"), f"{path}/rounds")
    write_csv(tables["manifest"], f"{path}/manifest")
    write_partitioned(tables["profiles"], f"{path}/seed_profiles", "round")
    write_heatmap(tables["heatmap"], tables["energy"], path)
    for name, table in (("H_matrix", wide_heatmap(tables["heatmap"])), ("E95_distance", tables["energy"])):
        table.write.mode("overwrite").partitionBy("grp").csv(f"{path}/{name}", header=True)


def write_heatmap(table: DataFrame, energy: DataFrame, path: str) -> None:
    """H as a table (grp, scale, bin, center, value) and its distances (grp, scale, distance), by group."""
    write_partitioned(table, f"{path}/heatmap", "grp")
    write_partitioned(energy, f"{path}/energy", "grp")


def read_heatmap(spark: SparkSession, path: str, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """H and distances as written; only the folders of the given groups are read."""
    h = spark.read.schema("scale double, bin int, center double, value double, grp string").parquet(f"{path}/heatmap")
    e = spark.read.schema("scale double, distance double, grp string").parquet(f"{path}/energy")
    return (h, e) if groups is None else (h.filter(F.col("grp").isin(*groups)), e.filter(F.col("grp").isin(*groups)))


def read_profiles(spark: SparkSession, path: str, rounds: list[int] | None = None, radius: float | None = None, digits: int | None = None) -> DataFrame:
    """Seed profiles as written; only the folders of the given rounds are read. Blocks of profiles take the
    radius they were made with, and round to digits, if given."""
    from ..operators.mapping import profile_rows

    rows = spark.read.parquet(f"{path}/seed_profiles")
    rows = rows if rounds is None else rows.filter(F.col("round").isin(*rounds))
    return rows if radius is None else profile_rows(rows, radius, digits)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A set of tables, a folder each: what an annotated matrix holds at the end of an analysis."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


# ------------------------------------------------------------------ adapters to the test tables


def points(spark: SparkSession, path: str) -> DataFrame:
    e = F.col("embedding")
    return read_table(spark, path, "embeddings").select(
        F.col("vec_id").alias("cell_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").cast("string").alias("label"), e.cast("array<double>").alias("vec")
    )


def points_dup(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))


def points_big(spark: SparkSession, path: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return read_table(spark, path, "orders").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") / 1000).cast("double").alias("x"), day.cast("double").alias("y"))


def expression(spark: SparkSession, path: str) -> DataFrame:
    line, orders, part = (read_table(spark, path, n) for n in ("lineitem", "orders", "part"))
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return rows.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def batches(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("batch"))


def morphology(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, features by customer."""
    bought = read_table(spark, path, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n_orders"), F.avg(F.col("o_totalprice").cast("double")).alias("mean_price"))
    customer = read_table(spark, path, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").cast("double").alias("balance"))
    return customer.join(bought, customer["cell_id"] == bought["o_custkey"]).drop("o_custkey")
