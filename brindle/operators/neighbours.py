"""Nearest neighbours, imputation, comparison of latents by neighbour ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators.aggregate import vector_mean

#: Decimals to which distances are rounded before they are ranked, so that order doesn't hang on the order of sums.
EXACT = 9


def distances(a: DataFrame, b: DataFrame, same: bool = False) -> DataFrame:
    """(a, b, d2) of all rows of ``a`` against all of ``b`` (id, vec): a stated query set, in blocks; ``b`` is broadcast only if Spark finds it small."""
    left = a.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    right = b.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    met = left.crossJoin(right)
    if same:
        met = met.where("a != b")
    return met.select("a", "b", F.round(V.sq_dist("va", "vb"), EXACT).alias("d2"))


#: Rows of a block of points about.
BLOCK = 1024


def blocked(points: DataFrame, name: str) -> DataFrame:
    """Rows of about ``BLOCK`` points each: their ids and vectors, in order of id."""
    n = points.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).alias("n"))
    dealt = points.select("id", "vec").crossJoin(F.broadcast(n)).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")))
    rows = dealt.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("p"))
    return rows.select(F.transform("p", lambda x: x["id"]).alias(f"{name}_ids"), F.transform("p", lambda x: x["vec"]).alias(f"{name}_vecs"))


def best_of_blocks(k: int, same: bool = False):  # noqa: ANN201
    """A kernel over rows of two blocks (a_ids, a_vecs, b_ids, b_vecs): the k nearest of b for each of a, by one matrix product and then exactly."""
    import numpy as np
    import pandas as pd

    def best(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for ia, va, ib, vb in zip(pdf["a_ids"], pdf["a_vecs"], pdf["b_ids"], pdf["b_vecs"], strict=True):
                x, y, ia, ib = np.array(va.tolist(), float), np.array(vb.tolist(), float), np.asarray(ia), np.asarray(ib)
                d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
                if same:
                    d2[ia[:, None] == ib[None, :]] = np.inf
                # a few more than k, then exactly: products round otherwise than differences
                m = min(k + 8, len(ib))
                near = np.argpartition(d2, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(len(ia)), m)
                col = near.ravel()
                keep = np.isfinite(d2[row, col])
                row, col = row[keep], col[keep]
                exact = np.round(((x[row] - y[col]) ** 2).sum(1), EXACT)
                order = np.lexsort((ib[col], exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                first = place < k
                yield pd.DataFrame({"a": ia[row[first]], "b": ib[col[first]], "d2": exact[first]})

    return best


def nearest(a: DataFrame, b: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(a, b, d2, rank): the k nearest of ``b`` for each row of ``a`` (id: long, vec), ties to the lower id.

    Blocks of points meet, not rows: distances of two blocks are one matrix product, and each block's k best go on, so
    no row gathers all distances.
    """
    met = blocked(a, "a").crossJoin(blocked(b, "b")).mapInPandas(best_of_blocks(k, same), "a long, b long, d2 double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))).where(F.col("rank") <= k).select("a", "b", "d2", "rank")


def by_direction(a: DataFrame, b: DataFrame, k: int, same: bool = False) -> DataFrame:
    """Nearest by direction: unit vectors, score ``-|u - v|``."""
    n = nearest(a.withColumn("vec", V.unit("vec")), b.withColumn("vec", V.unit("vec")), k, same)
    return n.select("a", "b", (-F.sqrt("d2")).alias("score"), "rank")


def fuzzy_graph(points: DataFrame, k: int = 15) -> DataFrame:
    """(src, dst, weight), src < dst: exp(-(d - nearest) / mean gap) joined by probabilistic sum over both directions."""
    n = nearest(points, points, k, same=True).withColumn("d", F.sqrt("d2"))
    low = n.groupBy("a").agg(F.min("d").alias("low"), F.avg("d").alias("mid"))
    w = n.join(low, "a").withColumn("w", F.exp(-(F.col("d") - F.col("low")) / F.greatest(F.col("mid") - F.col("low"), F.lit(1e-9))))
    sides = w.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("s"), F.when(F.count(F.lit(1)) == 2, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return sides.select("src", "dst", (F.col("s") - F.col("p")).alias("weight"))


def z_scored(points: DataFrame, floor: float = 0.0) -> DataFrame:
    """Each dimension less its mean over its population sd; 0 for a constant one (sd at most ``floor``)."""
    long = points.select("id", F.posexplode("vec").alias("dim", "x"))
    stat = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.join(F.broadcast(stat), "dim").select("id", "dim", F.when(F.col("s") > max(floor, 1e-12), (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))
    return z.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "z"))), lambda p: p["z"]).alias("vec"))


def in_metric(points: DataFrame, space: str) -> DataFrame:
    """Points in the metric of their cell space: embedding (cosine), log_simplex (Hellinger; given as theta), signed (z-score)."""
    if space == "embedding":
        return points.withColumn("vec", V.unit("vec"))
    if space == "log_simplex":
        return points.withColumn("vec", V.hellinger("vec"))
    if space == "signed":
        return z_scored(points, 1e-12)
    raise ValueError(f"unknown cell space {space}")


def impute(query: DataFrame, reference: DataFrame, counts: DataFrame, k: int = 25, temperature: float = 1.0, delta: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """(cell_id, feature_id, value): reference counts pooled over each query's neighbours, softmax(-d2 / 2 tau^2) weights.

    ``near`` (a, b, d2): neighbours that an index has found; without it all rows of the reference are compared.
    All-zero rows have no evidence: reference ones aren't matched, query ones get nothing. ``delta``: batch, feature_id, delta, with
    ``batch`` in the reference.
    """
    zero = lambda v: F.forall(v, lambda x: x == 0)
    if near is None:
        near = nearest(query.where(~zero(F.col("vec"))), reference.where(~zero(F.col("vec"))), k)
    tau = max(temperature, 1e-6)
    best = Window.partitionBy("a")
    e = near.withColumn("e", F.exp(-(F.col("d2") - F.min("d2").over(best)) / (2 * tau * tau)))
    w = e.withColumn("w", F.col("e") / F.greatest(F.sum("e").over(best), F.lit(1e-12))).select("a", "b", "w")
    c = counts
    if delta is not None:
        c = counts.join(reference.select(F.col("id").alias("cell_id"), "batch"), "cell_id").join(delta, ["batch", "feature_id"], "left").withColumn("value", F.col("value") / F.coalesce("delta", F.lit(1.0)))
    return w.join(c.select(F.col("cell_id").alias("b"), "feature_id", "value"), "b").groupBy(F.col("a").alias("cell_id"), "feature_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def group_means(points: DataFrame, least: int = 1) -> DataFrame:
    """(pb, n, vec) of groups with ``least`` cells at least; a group with a non-finite mean is left out."""
    m = vector_mean(points, ["pb"]).where(F.col("n") >= least)
    return m.where(~F.exists("mean", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))).select("pb", "n", F.col("mean").alias("vec"))


def pair_ranks(views: DataFrame) -> DataFrame:
    """(model, pb_a, pb_b, rank) of all pairs a < b: the lesser of the directional ranks 1 + closer points."""
    v = views.select("model", F.col("pb").alias("a"), F.col("vec").alias("va"))
    o = views.select("model", F.col("pb").alias("b"), F.col("vec").alias("vb"))
    d = v.join(o, "model").where("a != b").select("model", "a", "b", F.round(V.sq_dist("va", "vb"), EXACT).alias("d2"))
    r = d.withColumn("r", F.rank().over(Window.partitionBy("model", "a").orderBy("d2")))
    return r.groupBy("model", F.least("a", "b").alias("pb_a"), F.greatest("a", "b").alias("pb_b")).agg(F.min("r").alias("rank"))


def rank_bounds(n_groups: int, k: int = 15, far_share: float = 0.25) -> tuple[int, int] | None:
    """(near, far), or None where no rank of so many groups can be far."""
    far = max(2 * k, math.ceil(n_groups * far_share))
    return (k, far) if n_groups - 1 > far else None


def critique(views: DataFrame, k: int = 15, far_share: float = 0.25) -> DataFrame | None:
    """Pairs that some model holds near: each model's rank, the other models' median rank, and whether it merges what they keep apart.

    ``views``: model, pb, vec of one level. None if the level has too few groups.
    """
    bounds = rank_bounds(views.select("pb").distinct().count(), k, far_share)
    if bounds is None:
        return None
    near, far = bounds
    ranks = pair_ranks(views)
    # each model's k nearest of each group are the pairs whose directional rank, ties by id, is k at most
    v = views.select("model", F.col("pb").alias("a"), F.col("vec").alias("va"))
    o = views.select("model", F.col("pb").alias("b"), F.col("vec").alias("vb"))
    d = v.join(o, "model").where("a != b").select("model", "a", "b", F.round(V.sq_dist("va", "vb"), EXACT).alias("d2"))
    best = d.withColumn("r", F.row_number().over(Window.partitionBy("model", "a").orderBy("d2", "b"))).where(F.col("r") <= k)
    pairs = best.select(F.least("a", "b").alias("pb_a"), F.greatest("a", "b").alias("pb_b")).distinct()
    models = views.select("model").distinct()
    grid = pairs.crossJoin(models).join(ranks, ["model", "pb_a", "pb_b"], "left")
    others = grid.select("pb_a", "pb_b", F.col("model").alias("other"), F.col("rank").alias("other_rank")).where("other_rank is not null")
    answer = grid.join(others, ["pb_a", "pb_b"]).where("model != other").groupBy("model", "pb_a", "pb_b").agg(F.median("other_rank").alias("answer"))
    full = grid.join(answer, ["model", "pb_a", "pb_b"], "left")
    return full.withColumn("near", F.col("rank") <= near).withColumn("merged", F.coalesce((F.col("rank") <= near) & (F.col("answer") > far), F.lit(False)))


def critique_summary(pairs: DataFrame) -> DataFrame:
    """Near pairs, merges and merge rate of each model; a null rate where nothing is near."""
    g = pairs.groupBy("model").agg(F.count_if("near").alias("near_pairs"), F.count_if("merged").alias("merges"))
    return g.withColumn("merge_rate", F.col("merges") / F.when(F.col("near_pairs") > 0, F.col("near_pairs")))


def probe(calibration: DataFrame, query: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: threshold, cells, flagged, flag rate, p-value and verdict on query cells (cell_id, llik, total).

    A cell's fit is llik / total, 0 without counts; the threshold is the alpha quantile (nearest rank) of calibration fits.
    """
    from brindle.functions.numeric import normal_upper_tail
    from brindle.operators.rank import nearest_rank

    fit = F.when(F.col("total") > 0, F.round(F.col("llik") / F.col("total"), EXACT)).otherwise(0.0)
    cut = nearest_rank(calibration.select(fit.alias("fit")), [], "fit", alpha).withColumnRenamed("quantile", "threshold")
    g = query.select(fit.alias("fit")).crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("fit") < F.col("threshold")).alias("flagged"))
    g = g.withColumn("flag_rate", F.col("flagged") / F.col("cells"))
    se = F.greatest(F.sqrt(F.lit(alpha * (1 - alpha)) / F.col("cells")), F.lit(1e-12))
    g = g.withColumn("p_value", normal_upper_tail((F.col("flag_rate") - alpha) / se))
    return g.withColumn("novel", (F.col("flag_rate") > alpha) & (F.col("p_value") < 0.05))
