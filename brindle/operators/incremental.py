"""Carried pseudobulks: mergeable summaries that later rounds add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence(sums: DataFrame, sizes: DataFrame, generation: int) -> DataFrame:
    """(pb, feature_id, rate, n_cells, generation): evidence means ``sum / n``; no row where there is no count."""
    return sums.join(sizes, "pb").select("pb", "feature_id", (F.col("total") / F.col("n_cells")).alias("rate"), "n_cells", F.lit(generation).alias("generation"))


def merge(carried: DataFrame, new: DataFrame) -> DataFrame:
    """Rates of both rounds' cells together: means weighted by cells. A pb without a count of a feature still has its cells."""
    both = carried.unionByName(new)
    cells = both.select("pb", "generation", "n_cells").distinct().groupBy("pb").agg(F.sum("n_cells").alias("n_cells"))
    sums = both.groupBy("pb", "feature_id").agg(F.sum(F.col("rate") * F.col("n_cells")).alias("total"))
    return sums.join(cells, "pb").select("pb", "feature_id", (F.col("total") / F.col("n_cells")).alias("rate"), "n_cells")


def append(path: str, new: DataFrame) -> None:
    """Adds a round to the table; earlier rounds' files stay as they are."""
    new.write.mode("append").partitionBy("generation").parquet(path)


def weights(cells: DataFrame, carried: DataFrame) -> DataFrame:
    """(cell_id, weight): the number of cells that a carried column stands for, 1 for a cell."""
    return cells.join(carried.select(F.col("name"), "n_cells"), "name", "left").select("cell_id", F.coalesce("n_cells", F.lit(1)).alias("weight"))
