"""Held-out inference beyond scores: hidden counts, influence of added cells, a latent's own feature space, kept preprocessing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import floored_log
from brindle.operators.rank import hold_out


def hidden_likelihood(counts: DataFrame, fitted: Callable[[DataFrame], DataFrame], share: float = 0.2, seed: int = 0) -> DataFrame:
    """(cell_id, hidden, llik): a share of each cell's observed features is hidden and scored among the hidden ones.

    ``fitted`` makes rates (feature_id, rate, and cell_id if they differ by cell) of the counts that stay; it never sees the hidden ones.
    Features that no count that stays has aren't scored.
    """
    split = hold_out(counts.where("value > 0"), ["cell_id", "feature_id"], share, seed)
    rates = fitted(split.where("not held").drop("held"))
    h = split.where("held").join(rates, [c for c in ("cell_id", "feature_id") if c in rates.columns])
    lp = floored_log(F.col("rate") / F.sum("rate").over(Window.partitionBy("cell_id")))
    return h.withColumn("lp", lp).groupBy("cell_id").agg(F.sum("value").alias("hidden"), F.sum(F.col("value") * F.col("lp")).alias("llik"))


def influence(counts: DataFrame, shares: DataFrame, added: DataFrame, judged: DataFrame) -> DataFrame:
    """(role, effect, se): what a small step towards the added cells does to the likelihood of each role's cells.

    The model is one composition (feature_id, share); a cell's gradient in its logits is ``x - n p``. The effect is the mean over
    a role's cells of the product with the added cells' mean gradient; its error is the infinitesimal jackknife's.
    ``added``: cell_id; ``judged``: cell_id, role (target cells: benefit; old cells: minus forgetting).
    """
    a = counts.join(added.select("cell_id"), "cell_id", "left_semi")
    n = a.agg(F.count_distinct("cell_id").alias("cells"), F.sum("value").alias("all"))
    x = a.groupBy("feature_id").agg(F.sum("value").alias("x"))
    step = shares.join(x, "feature_id", "left").crossJoin(F.broadcast(n)).select("feature_id", "share", ((F.coalesce("x", F.lit(0)) - F.col("all") * F.col("share")) / F.col("cells")).alias("g"))
    base = step.agg(F.sum(F.col("share") * F.col("g")).alias("pg"))
    j = counts.join(judged, "cell_id").join(step.select("feature_id", "g"), "feature_id")
    per = j.groupBy("role", "cell_id").agg(F.sum(F.col("value") * F.col("g")).alias("xg"), F.sum("value").alias("n")).crossJoin(F.broadcast(base)).withColumn("e", F.col("xg") - F.col("n") * F.col("pg"))
    return per.groupBy("role").agg(F.avg("e").alias("effect"), (F.stddev_samp("e") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def resolve_space(theta: np.ndarray, counts: np.ndarray, dim: int = 16, passes: int = 200, rate: float = 0.02, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(alpha [topics, dim], rho [features, dim], b) of scores ``(theta alpha) . rho + b`` for frozen theta, by Adam on the multinomial loss, and the losses."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.3, (theta.shape[1], dim)), rng.normal(0, 0.1, (counts.shape[1], dim)), np.log(np.maximum(counts.sum(0) / max(counts.sum(), 1e-12), 1e-8))]
    m, v, total, losses = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], max(counts.sum(), 1e-12), []
    for step in range(1, passes + 1):
        z = theta @ p[0]
        s = z @ p[1].T + p[2]
        s -= s.max(1, keepdims=True)
        q = np.exp(s)
        q /= q.sum(1, keepdims=True)
        losses.append(float(-(counts * np.log(np.maximum(q, 1e-12))).sum() / total))
        e = (q * counts.sum(1, keepdims=True) - counts) / total
        g = [theta.T @ (e @ p[1]), e.T @ z, e.sum(0)]
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], losses


def prepared(spark: SparkSession, folder: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made once for equal settings: read back where it is whole, else built and written under their digest."""
    key = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def archetypes(points: DataFrame, counts: DataFrame, targets: tuple[int, ...] = (8, 16), least: int = 20) -> DataFrame:
    """(grouping, label, feature_id, total): sums of counts over partitions of several sizes, all in one scan; small clusters are folded.

    ``points``: id, vec.
    """
    from brindle.operators.aggregate import multi_grouped_sums
    from brindle.operators.cluster import k_means
    from brindle.operators.filters import fold_small

    groupings = {}
    cells = points.select(F.col("id").alias("cell_id"), "vec")
    for k in targets:
        labels = k_means(points, k).select(F.col("id").alias("cell_id"), F.col("cluster").alias("label"))
        groupings[str(k)] = fold_small(labels, cells, least)
    return multi_grouped_sums(counts, groupings)
