"""Masks, quality control, feature selection, pruning of small groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_features(counts: DataFrame, features: DataFrame) -> DataFrame:
    return counts.join(features.select("feature_id"), "feature_id", "left_semi")


def hide_features(counts: DataFrame, features: DataFrame) -> DataFrame:
    return counts.join(features.select("feature_id"), "feature_id", "left_anti")


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("detected"))


def cell_qc(counts: DataFrame, cells: DataFrame, near_empty: int = 10, mads: float = 3.0) -> DataFrame:
    """Two masks over all cells: ``emit_keep`` (not nearly empty) and ``train_keep`` (also no outlier of log totals by MAD).

    Carried cells (column ``carried``, if there) are exempt and stay out of the statistics.
    """
    c = cells if "carried" in cells.columns else cells.withColumn("carried", F.lit(False))
    t = c.select("cell_id", "carried").join(cell_totals(counts), "cell_id", "left").select("cell_id", "carried", F.coalesce("total", F.lit(0)).alias("total")).withColumn("x", F.log1p("total"))
    med = t.where("not carried").agg(F.median("x").alias("med"))
    mad = t.where("not carried").crossJoin(F.broadcast(med)).agg(F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"), F.first("med").alias("med"))
    emit = F.col("carried") | (F.col("total") >= near_empty)
    fine = F.abs(F.col("x") - F.col("med")) <= F.lit(mads * 1.4826) * F.col("mad")
    return t.crossJoin(F.broadcast(mad)).select("cell_id", "total", emit.alias("emit_keep"), (emit & (F.col("carried") | fine)).alias("train_keep"))


def feature_moments(counts: DataFrame, n_cells: int | DataFrame) -> DataFrame:
    """Mean and population variance over all cells, absent counts being zeros."""
    s = counts.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    n = F.lit(n_cells) if isinstance(n_cells, int) else F.col("n_cells")
    s = s if isinstance(n_cells, int) else s.crossJoin(F.broadcast(n_cells))
    mean = F.col("s") / n
    return s.select("feature_id", mean.alias("mean"), (F.col("ss") / n - mean * mean).alias("variance"))


def variable_features(counts: DataFrame, n_cells: int | DataFrame, top: int, must: DataFrame | None = None) -> DataFrame:
    """The ``top`` features by variance over mean, and those that must be in; ties to the lower id."""
    m = feature_moments(counts, n_cells).withColumn("dispersion", F.col("variance") / F.when(F.col("mean") > 0, F.col("mean")))
    best = m.where("dispersion is not null").orderBy(F.desc(F.round("dispersion", 9)), "feature_id").limit(top).select("feature_id")
    return best if must is None else best.union(must.select("feature_id")).distinct()


def kinetic_features(tracks: DataFrame, depth: DataFrame, min_reads: int, top: int) -> DataFrame:
    """Features with ``min_reads`` on both tracks, the ``top`` by variance over groups of ln(1 + 1e4 x / depth).

    ``tracks``: feature_id, pb, u, s; ``depth``: pb, depth of every group. The result is ordered by feature.
    """
    enough = tracks.groupBy("feature_id").agg(F.sum("u").alias("u"), F.sum("s").alias("s")).where((F.col("u") >= min_reads) & (F.col("s") >= min_reads))
    n = depth.agg(F.count(F.lit(1)).alias("n"))
    x = tracks.join(enough.select("feature_id"), "feature_id", "left_semi").join(depth, "pb").withColumn("y", F.log1p(1e4 * (F.col("u") + F.col("s")) / F.col("depth")))
    v = x.groupBy("feature_id").agg(F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy")).crossJoin(F.broadcast(n)).withColumn("v", F.col("yy") / F.col("n") - (F.col("y") / F.col("n")) ** 2)
    return v.orderBy(F.desc(F.round("v", 9)), "feature_id").limit(top).select("feature_id").orderBy("feature_id")


def covering_groups(sizes: DataFrame, share: float) -> DataFrame:
    """The largest groups that together hold ``share`` of all cells, renumbered by size; ``sizes``: pb, n."""
    w = Window.orderBy(F.desc("n"), "pb").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("new_pb", F.row_number().over(Window.orderBy(F.desc("n"), "pb")) - 1)
    want = sizes.agg(F.ceil(F.sum("n") * share).alias("want"))
    return ranked.crossJoin(F.broadcast(want)).where((F.col("before") < F.col("want")) | F.lit(share >= 1)).select("pb", "n", "new_pb")


def drop_small(labels: DataFrame, least: int) -> DataFrame:
    """Labels with clusters under ``least`` cells unassigned and the others renumbered in their order."""
    kept = labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    new = kept.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("new_label"))
    return labels.join(new, "label", "left").select("cell_id", F.col("new_label").alias("label"))


def fold_small(labels: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """Cells of clusters under ``least`` go to the nearest centroid of those that stay; if none would, the largest ``max(1, n / least)`` do.

    ``points``: cell_id, vec.
    """
    from brindle.functions.vectors import sq_dist
    from brindle.operators.aggregate import vector_mean

    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    stat = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("cells"))
    ranked = sizes.crossJoin(F.broadcast(stat)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    stay = ranked.where((F.col("n") >= least) | ((F.col("largest") < least) & (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("cells") / least))))).select("label")
    joined = points.select("cell_id", "vec").join(labels, "cell_id")
    centroids = vector_mean(joined.join(stay, "label", "left_semi"), ["label"])
    moved = joined.join(stay, "label", "left_anti")
    near = moved.crossJoin(centroids.select(F.col("label").alias("to"), F.col("mean").alias("c"))).groupBy("cell_id").agg(F.min_by("to", F.struct(F.round(sq_dist("vec", "c"), 9), F.col("to"))).alias("label"))
    return joined.join(stay, "label", "left_semi").select("cell_id", "label").unionByName(near)


def upper_median(values: DataFrame, value: str) -> DataFrame:
    """One row: the element at place n / 2 of the sorted values."""
    from brindle.operators.rank import placed

    ranked = placed(values.select(value), value)
    return ranked.where(F.col("__place") == F.floor(F.col("__n") / 2)).select(F.col(value).alias("median"))


def drop_low_baseline(features: DataFrame, value: str) -> DataFrame:
    """Features whose baseline is at least the upper median of all."""
    return features.crossJoin(F.broadcast(upper_median(features, value))).where(F.col(value) >= F.col("median")).drop("median")


def winsorize(points: DataFrame, width: float) -> DataFrame:
    """(id, dim, value) with each dimension held within ``median +- width * 1.4826 * MAD``, upper medians.

    A dimension of under 8 points, or of MAD 1e-12 or less, stays.
    """

    def middle(rows: DataFrame, name: str) -> DataFrame:
        # sorted where they can spill; no row holds a dimension
        one = Window.partitionBy("dim")
        r = rows.withColumn("r", F.row_number().over(one.orderBy("v"))).withColumn("n", F.count("v").over(one))
        return r.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("dim", F.col("v").alias(name), "n")

    med = middle(points.where("value is not null").select("dim", F.col("value").alias("v")), "med")
    with_med = points.join(med, "dim")
    mad = middle(with_med.where("value is not null").select("dim", F.abs(F.col("value") - F.col("med")).alias("v")), "mad").drop("n")
    reach = F.lit(width * 1.4826) * F.col("mad")
    held = F.least(F.greatest(F.col("value"), F.col("med") - reach), F.col("med") + reach)
    return with_med.join(mad, "dim").select("id", "dim", F.when((F.col("n") < 8) | (F.col("mad") <= 1e-12), F.col("value")).otherwise(held).alias("value"))
