"""Queries: layouts of groups, warm starts, posterior draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregate, collapse, layout, start
from brindle.plans.base import Registry, sql
from brindle.sources import counts as S

R = Registry()


def _groups(spark: SparkSession, d: str) -> DataFrame:
    p = S.latent(spark, d).withColumn("pb", F.col("label") * 8 + F.pmod(F.xxhash64("cell_id"), F.lit(8)))
    return aggregate.vector_mean(p, ["pb"]).select(F.col("pb").cast("long").alias("id"), F.col("mean").alias("vec"))


def _add(method: str) -> None:
    R.add(f"l3_{method}")(lambda spark, d: layout.layout(_groups(spark, d), method))


for _m in (*layout.METHODS, *layout.TREES):
    _add(_m)


@R.add(
    "m15_gathered",
    sql(
        "SELECT f.id AS feature_id, f.dim, round(coalesce(CASE WHEN f.id % 3 > 0 THEN f.x END, g.m, a.m), 6) AS x FROM dims f LEFT JOIN (SELECT label, dim, avg(x) AS m FROM dims WHERE id % 3 > 0 GROUP BY 1, 2) g ON g.label = f.label AND g.dim = f.dim JOIN (SELECT dim, avg(x) AS m FROM dims WHERE id % 3 > 0 GROUP BY 1) a ON a.dim = f.dim",
        "latent",
        "dims",
    ),
)
def gathered(spark: SparkSession, d: str) -> DataFrame:
    """A third of the rows is unknown and is filled from its group."""
    p = S.latent(spark, d).withColumnRenamed("cell_id", "feature_id")
    g = start.gathered(p, p.where("feature_id % 3 > 0").select("feature_id", "vec"), p.select("feature_id", F.col("label").alias("grp")))
    return g.select("feature_id", F.posexplode("vec").alias("dim", "x")).select("feature_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@R.add("m14_preset_rows", sql("SELECT f.id AS feature_id, f.dim, round(o.x, 6) AS x, 'freeze' AS mode FROM dims f JOIN dims o ON o.id = f.id AND o.dim = f.dim WHERE f.id % 4 > 0", "latent", "dims"))
def preset_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an earlier table that lacks a quarter of the features, spelled otherwise."""
    p = S.latent(spark, d)
    old = p.where("cell_id % 4 > 0").select(F.concat(F.lit("FEATURE"), F.col("cell_id")).alias("name"), "vec")
    got = start.preset_rows(old, p.select(F.col("cell_id").alias("feature_id"), F.concat(F.lit("feature"), F.col("cell_id")).alias("name")), "freeze")
    return got.select("feature_id", F.posexplode("vec").alias("dim", "x"), "mode").select("feature_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"), "mode")


@R.add("r8_gamma_mean", sql("SELECT CAST(batch AS BIGINT) AS pb, feature_id, round((1.0 + t) / (1.0 + n), 6) AS mean FROM (SELECT batch, feature_id, CAST(sum(value) AS DOUBLE) AS t FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2) JOIN (SELECT batch, count(*) AS n FROM cells GROUP BY 1) USING (batch)", "counts", "cells"))
def gamma_mean(spark: SparkSession, d: str) -> DataFrame:
    s, n = collapse.pseudobulk(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")))
    return start.gamma_draws(s, n).select("pb", "feature_id", F.round("mean", 6).alias("mean"))


@R.add("m2_joint_loadings")
def joint_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Two modalities that share cells, their features stacked under names of their own."""
    c = S.customer_counts(spark, d)
    both = c.withColumn("feature_id", F.col("feature_id") * 2).unionByName(c.withColumn("feature_id", F.col("feature_id") * 2 + 1).withColumn("value", F.col("value") + 1))
    s, n = collapse.pseudobulk(both, S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")))
    return collapse.loadings(collapse.log_rates(s, n), 5)


@R.add("c3_block_model")
def block_model(spark: SparkSession, d: str) -> DataFrame:
    ids, x = layout.points(_groups(spark, d))
    leaves = start.block_model(layout.affinity(x), 3)
    return spark.createDataFrame([(int(i), int(k)) for i, k in zip(ids, leaves, strict=True)], "id long, leaf int")


@R.add("l2_matching")
def matching(spark: SparkSession, d: str) -> DataFrame:
    ids, x = layout.points(_groups(spark, d))
    return spark.createDataFrame([(int(i), int(k)) for i, k in zip(ids, layout.matching(layout.affinity(x), 20), strict=True)], "id long, landmark int")
