"""Long sparse counts ``(cell_id, feature_id, value)``: a zero is the absence of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stack(parts: dict[str, DataFrame], name: str = "cell_name") -> DataFrame:
    """Counts of several inputs over one feature axis: names get ``@input`` where there is more than one, batch is the input."""
    many = len(parts) > 1
    out = None
    for label, df in sorted(parts.items()):
        df = df.withColumn("batch", F.lit(label))
        if many:
            df = df.withColumn(name, F.concat(F.col(name), F.lit(f"@{label}")))
        out = df if out is None else out.unionByName(df)
    assert out is not None, "no inputs"
    return out


def stack_modalities(parts: list[DataFrame], modalities: list[str]) -> DataFrame:
    """Counts of several modalities for the cells that all of them hold."""
    if not parts or len(parts) % len(modalities):
        raise ValueError("the number of inputs isn't a multiple of the number of modalities")
    per = len(parts) // len(modalities)
    whole = None
    for i, df in enumerate(parts):
        df = df.withColumn("modality", F.lit(modalities[i // per]))
        whole = df if whole is None else whole.unionByName(df)
    both = whole.groupBy("cell_id").agg(F.count_distinct("modality").alias("m")).where(F.col("m") == len(modalities)).select("cell_id")
    return whole.join(both, "cell_id", "left_semi")


def one_batch(cells: DataFrame) -> DataFrame:
    return cells.withColumn("batch", F.lit("all"))


def check_values(counts: DataFrame) -> DataFrame:
    """The counts, failing at run time on a negative or non-finite value."""
    bad = (F.col("value") < 0) | F.isnan(F.col("value").cast("double"))
    return counts.withColumn("value", F.when(bad, F.raise_error(F.lit("a count is negative or not a number"))).otherwise(F.col("value")))


def write(counts: DataFrame, path: str, cluster_by: str = "cell_id") -> None:
    """Parquet, sorted by cell within files so that a range of cells reads few row groups."""
    counts.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by).write.mode("overwrite").parquet(path)


def customer_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of parts by customer: quantities, whole numbers."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").cast("long").alias("value"))


def customer_cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("batch"), F.col("c_mktsegment").alias("stratum"))


def part_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


def latent(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def by_name(name: Column, ordinal: Column) -> Column:
    """First of equal names by ordinal."""
    return F.min_by(name, ordinal)
