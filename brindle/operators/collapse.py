"""Preprocessing: projection, sign partition, pseudobulks and their batch model, singular vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import drawn

#: Most pseudobulks that a driver-side decomposition takes.
MOST_PB = 4096


def gaussian(key: Column, dim: Column, seed: int = 0) -> Column:
    """A standard normal number for each key and dimension, from two drawn ones (Box-Muller): alike on every run."""
    return F.sqrt(-2.0 * F.log(drawn(key, dim, seed=2 * seed))) * F.cos(2 * F.pi() * drawn(key, dim, seed=2 * seed + 1))


def project(counts: DataFrame, cells: DataFrame, dims: int = 50, weights: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(cell_id, dim, x): hash-seeded Gaussian projection of ln(1 + count), less the mean of the cell's batch."""
    c = counts.withColumn("v", F.log1p("value"))
    if weights is not None:
        c = c.join(weights, "feature_id").withColumn("v", F.col("v") * F.col("weight"))
    basis = c.select("feature_id").distinct().select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")).withColumn("g", gaussian(F.col("feature_id"), F.col("dim"), seed))
    x = c.join(basis, "feature_id").groupBy("cell_id", "dim").agg(F.sum(F.col("v") * F.col("g")).alias("x"))
    b = x.join(cells.select("cell_id", "batch"), "cell_id")
    means = b.groupBy(F.col("batch").alias("of"), F.col("dim").alias("on")).agg(F.avg("x").alias("mean"))
    return b.join(means, F.col("batch").eqNullSafe(F.col("of")) & (F.col("dim") == F.col("on"))).select("cell_id", "dim", (F.col("x") - F.col("mean")).alias("x"))


def sign_partition(projection: DataFrame, bits: int, stratum: DataFrame | None = None) -> DataFrame:
    """(cell_id, code, pb): codes of the signs of the first ``bits`` dimensions, numbered without gaps; strata stay apart."""
    code = projection.where(F.col("dim") < bits).groupBy("cell_id").agg(F.sum(F.when(F.col("x") > 0, F.pow(F.lit(2.0), F.col("dim"))).otherwise(0.0)).cast("long").alias("code"))
    s = code.withColumn("stratum", F.lit(0)) if stratum is None else code.join(stratum.select("cell_id", "stratum"), "cell_id", "left").withColumn("stratum", F.coalesce("stratum", F.lit(0)))
    ids = s.select("stratum", "code").distinct().withColumn("pb", F.row_number().over(Window.orderBy("stratum", "code")) - 1)
    return s.join(ids, ["stratum", "code"]).select("cell_id", "code", "pb")


def pseudobulk(counts: DataFrame, partition: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pb, feature_id, total) and (pb, n_cells) with cell weights."""
    p = partition.withColumn("w", F.col(weight) if weight else F.lit(1))
    sums = counts.join(p, "cell_id").groupBy("pb", "feature_id").agg(F.sum(F.col("value") * F.col("w")).alias("total"))
    return sums, p.groupBy("pb").agg(F.sum("w").alias("n_cells"))


def batch_model(sums: DataFrame, sizes: DataFrame, passes: int = 5, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pb, feature_id, mu) and (batch, feature_id, delta) of ``E[total] = mu * sum over b of delta n``, by alternating ratios.

    ``sums``: pb, batch, feature_id, total; ``sizes``: pb, batch, n. Passes are written under ``folder`` to cut the lineage.
    """
    spark = sums.sparkSession
    delta = sums.select("batch", "feature_id").distinct().withColumn("delta", F.lit(1.0))
    mu = None
    for i in range(passes):
        exposed = sums.select("pb", "feature_id").distinct().join(sizes, "pb").join(delta, ["batch", "feature_id"], "left").groupBy("pb", "feature_id").agg(F.sum(F.col("n") * F.coalesce("delta", F.lit(1.0))).alias("e"))
        got = sums.groupBy("pb", "feature_id").agg(F.sum("total").alias("t"))
        mu = got.join(exposed, ["pb", "feature_id"]).select("pb", "feature_id", (F.col("t") / F.col("e")).alias("mu"))
        want = mu.join(sizes, "pb").groupBy("batch", "feature_id").agg(F.sum(F.col("mu") * F.col("n")).alias("p"))
        obs = sums.groupBy("batch", "feature_id").agg(F.sum("total").alias("o"))
        delta = obs.join(want, ["batch", "feature_id"]).select("batch", "feature_id", F.least(F.greatest((F.col("o") + 1) / (F.col("p") + 1), F.lit(0.01)), F.lit(100.0)).alias("delta"))
        if folder:
            for name, df in (("mu", mu), ("delta", delta)):
                df.write.mode("overwrite").parquet(f"{folder}/{name}-{i}")
            mu, delta = spark.read.schema(mu.schema).parquet(f"{folder}/mu-{i}"), spark.read.schema(delta.schema).parquet(f"{folder}/delta-{i}")
    return mu, delta


def dispersion(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(feature_id, mean, phi): moment estimate ``phi = mean^2 / (variance - mean)`` over observed pseudobulk rates; null where not overdispersed."""
    n = sizes.agg(F.count(F.lit(1)).alias("pbs"))
    r = sums.join(sizes, "pb").withColumn("r", F.col("total") / F.col("n_cells"))
    m = r.groupBy("feature_id").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("pbs")
    var = F.col("ss") / F.col("pbs") - mean * mean
    return m.select("feature_id", mean.alias("mean"), F.when(var > mean, mean * mean / F.when(var > mean, var - mean)).alias("phi"))


def log_rates(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    return sums.join(sizes, "pb").select("pb", "feature_id", F.log1p(1e4 * F.col("total") / F.col("n_cells")).alias("x"))


def gram(rates: DataFrame, pbs: list) -> np.ndarray:
    """The products of all pseudobulks' rates (pb, feature_id, x), summed over features.

    Each task multiplies the rows of its features, many at a time, and adds them up; sums of tasks are added row by row of the matrix, so
    that only the matrix itself, ``MOST_PB`` wide at most, reaches the driver.
    """
    place = {p: i for i, p in enumerate(pbs)}

    def partial(batches):  # noqa: ANN001, ANN202
        total = np.zeros((len(place), len(place)))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                x = np.zeros((len(part), len(place)))
                for i, (p, v) in enumerate(zip(part["p"], part["v"], strict=True)):
                    x[i, [place[k] for k in p.tolist()]] = v
                total += x.T @ x
        if total.any():
            yield pd.DataFrame({"i": np.arange(len(place)), "row": list(total)})

    def added(key, pdf: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"i": [key[0]], "row": [sum(pdf["row"].to_list())]})

    per = rates.groupBy("feature_id").agg(F.collect_list(F.struct("pb", F.col("x").cast("double").alias("x"))).alias("s")).select(F.col("s.pb").alias("p"), F.col("s.x").alias("v"))
    rows = per.mapInPandas(partial, "i int, row array<double>").groupBy("i").applyInPandas(added, "i int, row array<double>")
    out = np.zeros((len(place), len(place)))
    for r in rows.toLocalIterator():
        out[r["i"]] = r["row"]
    return out


def singular_vectors(rates: DataFrame, rank: int = 10) -> tuple[np.ndarray, np.ndarray, list]:
    """Left vectors [features, rank] (signs by their largest entry), values, and feature ids, of (pb, feature_id, x).

    The features-by-features product isn't formed: the Gram matrix of pseudobulks is summed by Spark and is at most ``MOST_PB`` wide.
    """
    pbs = [r[0] for r in rates.select("pb").distinct().orderBy("pb").limit(MOST_PB + 1).collect()]
    if len(pbs) > MOST_PB:
        raise ValueError(f"more than {MOST_PB} pseudobulks")
    values, vectors = np.linalg.eigh(gram(rates, pbs))
    order = np.argsort(-values)[:rank]
    s = np.sqrt(np.maximum(values[order], 0))
    v = vectors[:, order]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
    return v, s, pbs


def loadings(rates: DataFrame, rank: int = 10) -> DataFrame:
    """(feature_id, k, u): feature loadings ``X v / s``."""
    spark = rates.sparkSession
    v, s, pbs = singular_vectors(rates, rank)
    rows = [(p, k, float(v[i, k] / max(s[k], 1e-12))) for i, p in enumerate(pbs) for k in range(v.shape[1])]
    right = spark.createDataFrame(rows, "pb int, k int, v double")
    return rates.withColumn("pb", F.col("pb").cast("int")).join(right, "pb").groupBy("feature_id", "k").agg(F.sum(F.col("x") * F.col("v")).alias("u"))


def standardized_cells(counts: DataFrame) -> DataFrame:
    """(cell_id, feature_id, x): unit length, times 1e4, ln(1 + .), standardized over the cell's stored entries only."""
    w = Window.partitionBy("cell_id")
    y = counts.withColumn("y", F.log1p(1e4 * F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(w))))
    sd = F.stddev_pop("y").over(w)
    return y.select("cell_id", "feature_id", F.when(sd > 1e-12, (F.col("y") - F.avg("y").over(w)) / sd).otherwise(0.0).alias("x"))


def nystrom(cells: DataFrame, u: DataFrame) -> DataFrame:
    """(cell_id, k, z): standardized cells on the loadings."""
    return cells.join(u, "feature_id").groupBy("cell_id", "k").agg(F.sum(F.col("x") * F.col("u")).alias("z"))


def adjusted_triplets(counts: DataFrame, cells: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts over the batch's ratio, rounded, those under 1 dropped."""
    c = counts.join(cells.select("cell_id", "batch"), "cell_id").join(delta, ["batch", "feature_id"], "left")
    return c.select("cell_id", "feature_id", F.round(F.col("value") / F.coalesce("delta", F.lit(1.0))).cast("long").alias("value")).where("value >= 1")


def coarsen(profiles: DataFrame, bin_width: float, score: Column) -> DataFrame:
    """(feature_id, grp): features dealt to bins of a score, bins numbered without gaps."""
    b = profiles.select("feature_id", F.floor(score / bin_width).alias("bin"))
    ids = b.select("bin").distinct().withColumn("grp", F.row_number().over(Window.orderBy("bin")) - 1)
    return b.join(ids, "bin").select("feature_id", "grp")


def expand_dictionary(group_beta: DataFrame, groups: DataFrame, feature_totals: DataFrame) -> DataFrame:
    """(feature_id, k, beta): ``log beta of the group + log of the feature's share in the group``, half a count added to each total."""
    t = groups.join(feature_totals, "feature_id", "left").withColumn("t", F.coalesce("total", F.lit(0)) + 0.5)
    share = F.log(F.col("t") / F.sum("t").over(Window.partitionBy("grp")))
    return t.select("feature_id", "grp", share.alias("ls")).join(group_beta, "grp").select("feature_id", "k", (F.col("beta") + F.col("ls")).alias("beta"))
