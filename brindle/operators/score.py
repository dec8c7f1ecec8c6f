"""Rates, batch ratios, held-out scores, residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import delta_ratio, finite_or_null, floored_log, nb_weight
from brindle.operators.aggregate import composition


#: Topics up to which cells and features meet with all their topics in one row.
TOPICS = 64


def topic_rates(theta: DataFrame, beta: DataFrame) -> DataFrame:
    """(cell_id, feature_id, rate) = sum over k of theta * exp(beta); inputs (cell_id, k, theta) and (feature_id, k, beta).

    Up to ``TOPICS`` topics, each pair is one row of a product with a column a topic, which nothing shuffles or adds up; a pair without
    a common topic has no rate.
    """
    ks = [r[0] for r in beta.select("k").where("k is not null").distinct().orderBy("k").limit(TOPICS + 1).collect()]
    if len(ks) > TOPICS or not ks:
        return theta.join(beta, "k").groupBy("cell_id", "feature_id").agg(F.sum(F.col("theta") * F.exp("beta")).alias("rate"))
    wide = lambda t, key, name, x: t.groupBy(key).agg(*(F.sum(F.when(F.col("k") == k, x)).alias(f"{name}{i}") for i, k in enumerate(ks)))
    # features are dealt out, as few rows make many pairs
    dealt = wide(beta, "feature_id", "__b", F.exp("beta")).repartition(int(theta.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = dealt.crossJoin(wide(theta, "cell_id", "__t", F.col("theta")))
    parts = [F.col(f"__t{i}") * F.col(f"__b{i}") for i in range(len(ks))]
    total = F.coalesce(parts[0], F.lit(0.0))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0.0))
    return both.where(F.coalesce(*parts).isNotNull()).select("cell_id", "feature_id", total.alias("rate"))


def embedding_rates(z: DataFrame, rho: DataFrame) -> DataFrame:
    """(cell_id, feature_id, rate): softmax over features of ``rho . z + b``; inputs (cell_id, vec), (feature_id, rho, b)."""
    from brindle.functions.vectors import dot

    s = z.crossJoin(rho).select("cell_id", "feature_id", (dot("rho", "vec") + F.col("b")).alias("s"))
    w = Window.partitionBy("cell_id")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("cell_id", "feature_id", (F.col("e") / F.sum("e").over(w)).alias("rate"))


def delta_sums(counts: DataFrame, cells: DataFrame, profile: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(batch, feature_id, obs, pred): obs = sum of w x, pred = sum of w lib rate, for a rate by feature (feature_id, rate).

    A rate that is the same for a batch's cells goes outside the sum, so the cells-by-features product is never formed.
    ``lib`` counts the features of the profile alone. ``weights``: feature_id, phi, mu.
    """
    mapped = counts.join(profile.select("feature_id"), "feature_id", "left_semi").join(cells.select("cell_id", "batch"), "cell_id")
    lib = mapped.groupBy("batch").agg(F.sum("value").alias("lib"))
    obs = mapped.groupBy("batch", "feature_id").agg(F.sum("value").alias("x"))
    p = profile if weights is None else profile.join(weights, "feature_id", "left")
    w = F.lit(1.0) if weights is None else nb_weight("phi", F.coalesce("mu", F.lit(0.0)))
    grid = p.withColumn("w", w).crossJoin(lib).join(obs, ["batch", "feature_id"], "left")
    return grid.select("batch", "feature_id", (F.col("w") * F.coalesce("x", F.lit(0))).alias("obs"), (F.col("w") * F.col("lib") * F.col("rate")).alias("pred"))


def fitted_delta(sums: DataFrame) -> DataFrame:
    return sums.select("batch", "feature_id", delta_ratio("obs", "pred").alias("delta"))


def crossfit_delta(fold_sums: DataFrame, prior: float = 1.0) -> DataFrame:
    """(batch, fold, feature_id, delta) from the other folds of the batch, with a prior at the batch's own ratio.

    ``fold_sums``: batch, fold, feature_id, obs, pred. The batch's total less the fold is a window, not a second join.
    """
    over, all_ = Window.partitionBy("batch", "feature_id"), Window.partitionBy("batch")
    rest = fold_sums.withColumn("o", F.sum("obs").over(over) - F.col("obs")).withColumn("p", F.sum("pred").over(over) - F.col("pred"))
    scale = F.when(F.sum("pred").over(all_) > 0, F.sum("obs").over(all_) / F.sum("pred").over(all_)).otherwise(1.0)
    rest = rest.withColumn("scale", scale)
    return rest.select("batch", "fold", "feature_id", delta_ratio("o", "p", prior, F.col("scale")).alias("delta"))


def delta_plan(batches: DataFrame, trained: DataFrame, mode: str) -> DataFrame:
    """(batch, plan): Trained, Fitted or Unit for each batch under a mode (none, train, auto, heldout, crossfit)."""
    t = trained.select("batch").distinct().withColumn("known", F.lit(True))
    b = batches.select("batch").distinct()
    stat = b.agg(F.count(F.lit(1)).alias("n")).crossJoin(t.agg(F.count(F.lit(1)).alias("m")))
    known = F.coalesce("known", F.lit(False))
    plans = {"none": F.lit("Unit"), "train": F.when(known, "Trained").otherwise("Unit"), "heldout": F.lit("Fitted"), "crossfit": F.lit("Fitted"), "auto": F.when(known, "Trained").when((F.col("m") > 0) & (F.col("n") >= 2), "Fitted").otherwise("Unit")}
    return b.join(t, "batch", "left").crossJoin(F.broadcast(stat)).select("batch", plans[mode].alias("plan"))


def null_scores(counts: DataFrame, null: DataFrame) -> DataFrame:
    """(cell_id, total, llik) under one composition (feature_id, share) for all cells."""
    ln = null.select("feature_id", floored_log("share").alias("lp"))
    return counts.join(ln, "feature_id").groupBy("cell_id").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("lp")).alias("llik"))


def batch_adjusted_null(null: DataFrame, delta: DataFrame) -> DataFrame:
    """(batch, feature_id, share) of ``delta * null``, scaled to 1 in each batch."""
    p = null.join(delta, "feature_id").withColumn("v", F.col("delta") * F.col("share"))
    return p.select("batch", "feature_id", (F.col("v") / F.sum("v").over(Window.partitionBy("batch"))).alias("share"))


def smoothed_null(counts: DataFrame, cells: DataFrame, null: DataFrame) -> DataFrame:
    """(batch, feature_id, share): a batch's composition with as many pseudo-counts of the null as there are scored features."""
    kappa = null.agg(F.count(F.lit(1)).cast("double").alias("kappa"))
    b = counts.join(cells.select("cell_id", "batch"), "cell_id").groupBy("batch", "feature_id").agg(F.sum("value").alias("x"))
    grid = cells.select("batch").distinct().crossJoin(null).join(b, ["batch", "feature_id"], "left").crossJoin(F.broadcast(kappa))
    v = F.coalesce("x", F.lit(0)) + F.col("kappa") * F.col("share")
    return grid.withColumn("v", v).select("batch", "feature_id", (F.col("v") / F.sum("v").over(Window.partitionBy("batch"))).alias("share"))


def multinomial_scores(counts: DataFrame, rates: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, total, llik): rates (group or cell, feature_id, rate) scaled over the scored features, floored, summed on counts.

    With ``cells`` (cell_id, group) rates are by group.
    """
    key = "group" if cells is not None else "cell_id"
    p = rates.withColumn("lp", floored_log(F.col("rate") / F.sum("rate").over(Window.partitionBy(key))))
    c = counts if cells is None else counts.join(cells, "cell_id")
    return c.join(p.select(key, "feature_id", "lp"), [key, "feature_id"]).groupBy("cell_id").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("lp")).alias("llik"))


def ceiling_scores(counts: DataFrame) -> DataFrame:
    """(cell_id, ceiling): the likelihood of each cell under its own composition, the most that a model can reach."""
    t = Window.partitionBy("cell_id")
    return counts.where("value > 0").withColumn("lp", F.log(F.col("value") / F.sum("value").over(t))).groupBy("cell_id").agg(F.sum(F.col("value") * F.col("lp")).alias("ceiling"))


def predictive(cells: DataFrame, model: DataFrame, null: DataFrame) -> DataFrame:
    """cell_id, total, llik, null_llik and both per count, null for cells without scored counts."""
    n = null.select("cell_id", F.col("llik").alias("null_llik"))
    t = cells.select("cell_id").join(model, "cell_id", "left").join(n, "cell_id", "left")
    positive = F.when(F.col("total") > 0, F.col("total"))
    return t.select("cell_id", F.coalesce("total", F.lit(0)).alias("total"), "llik", "null_llik", (F.col("llik") / positive).alias("llik_per_count"), (F.col("null_llik") / positive).alias("null_per_count"))


def gain(scores: DataFrame) -> DataFrame:
    """One row: likelihood gained over the null for each count, and the means that skip cells without a score."""
    return scores.agg(((F.sum("llik") - F.sum("null_llik")) / F.sum("total")).alias("gain"), F.avg(finite_or_null("llik_per_count")).alias("mean_llik"), F.avg(finite_or_null("null_per_count")).alias("mean_null"))


def residual_counts(counts: DataFrame, rates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(cell_id, feature_id, value) = x / (mu lambda) with lambda = sum x / sum mu of the cell; features without a rate pass through.

    The scale of a cell's rates cancels out. With whole rates and counts sums and products are exact below 2^53, so the
    order of rows changes nothing; the only rounding is the division's.
    """
    sums = counts.join(rates, ["cell_id", "feature_id"], "left")
    mu = rates.groupBy("cell_id").agg(F.sum("rate").cast("double").alias("mu"))
    x = sums.where("rate is not null").groupBy("cell_id").agg(F.sum("value").cast("double").alias("x"))
    value, rate = F.col("value").cast("double"), F.col("rate").cast("double")
    v = F.when(F.col("rate").isNull() | F.col("x").isNull() | (F.col("mu") == 0), value).otherwise(value * F.col("mu") / F.greatest(rate * F.col("x"), 1e-12 * F.col("mu")))
    return sums.join(mu.join(x, "cell_id"), "cell_id", "left").select("cell_id", "feature_id", v.alias("value")).where(F.col("value") > threshold)


def gaussian_scores(residuals: DataFrame, n_features: int) -> DataFrame:
    """(cell_id, llik, llik_per_gene) of ``-D/2 (1 + ln 2 pi s2)`` with s2 the mean squared residual, 1e-12 at least."""
    s2 = F.greatest(F.sum(F.col("r") * F.col("r")) / n_features, F.lit(1e-12))
    l = -0.5 * n_features * (1 + F.log(2 * F.pi() * s2))
    return residuals.groupBy("cell_id").agg(l.alias("llik"), (l / n_features).alias("llik_per_gene"))


def feature_agreement(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """(feature_id, spearman, pearson_log1p, mean_observed) over cells with either value."""
    from brindle.operators.rank import agreement

    both = observed.join(predicted, ["cell_id", "feature_id"], "full").select("feature_id", F.coalesce("value", F.lit(0.0)).cast("double").alias("x"), F.coalesce("rate", F.lit(0.0)).alias("y"))
    return agreement(both, "feature_id").join(both.groupBy("feature_id").agg(F.avg("x").alias("mean_observed")), "feature_id")
