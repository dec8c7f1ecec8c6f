"""Two-track counts and splicing trajectories: tracks, levels on a grid, likelihoods, readouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import spliced_level, unspliced_level
from brindle.operators.shared import shared_folder, summed, written


def split_tracks(counts: DataFrame) -> DataFrame:
    """(cell_id, gene, u, s) of features named ``gene/count/spliced`` and ``gene/count/unspliced``; others are left out."""
    parts = F.split("feature", "/")
    t = counts.withColumn("gene", parts[0]).withColumn("track", F.element_at(parts, -1)).where(F.size(parts).between(3, 3) & F.col("track").isin("spliced", "unspliced"))
    pick = lambda x: F.sum(F.when(F.col("track") == x, F.col("value")).otherwise(0))
    return t.groupBy("cell_id", "gene").agg(pick("unspliced").alias("u"), pick("spliced").alias("s"))


def rescaled(tracks: DataFrame, cells: DataFrame, delta: DataFrame) -> DataFrame:
    """Tracks over the batch's ratio, each cell scaled back to its own total."""
    w = Window.partitionBy("cell_id")
    x = tracks.join(cells.select("cell_id", "batch"), "cell_id").join(delta, ["batch", "gene"], "left").withColumn("d", F.coalesce("delta", F.lit(1.0)))
    x = x.withColumn("uu", F.col("u") / F.col("d")).withColumn("ss", F.col("s") / F.col("d"))
    k = F.sum(F.col("u") + F.col("s")).over(w) / F.sum(F.col("uu") + F.col("ss")).over(w)
    return x.select("cell_id", "gene", (F.col("uu") * k).alias("u"), (F.col("ss") * k).alias("s"))


def levels(genes: DataFrame, positions: DataFrame) -> DataFrame:
    """(gene, pos, u, s) at times ``t`` of positions, from rest, for rates (gene, alpha, beta, gamma)."""
    g = genes.crossJoin(positions)
    return g.select("gene", "pos", unspliced_level(F.lit(0.0), "alpha", "beta", "t").alias("u"), spliced_level(F.lit(0.0), F.lit(0.0), "alpha", "beta", "gamma", "t").alias("s"))


def grid_likelihood(tracks: DataFrame, grid: DataFrame, floor: float = 1e-9) -> DataFrame:
    """(cell_id, pos, ll): each cell's reads, by multinomial over genes and tracks, at every position."""
    w = Window.partitionBy("pos")
    n = F.sum(F.col("u") + F.col("s") + 2 * floor).over(w)
    lp = grid.select("gene", "pos", F.log((F.col("u") + floor) / n).alias("lu"), F.log((F.col("s") + floor) / n).alias("ls"))
    return tracks.join(lp, "gene").groupBy("cell_id", "pos").agg(F.sum(F.col("u") * F.col("lu") + F.col("s") * F.col("ls")).alias("ll"))


def posterior(likelihood: DataFrame) -> DataFrame:
    """(cell_id, pos, q): softmax over positions."""
    w = Window.partitionBy("cell_id")
    e = likelihood.withColumn("e", F.exp(F.col("ll") - F.max("ll").over(w)))
    return e.select("cell_id", "pos", (F.col("e") / F.sum("e").over(w)).alias("q"))


def time_readout(post: DataFrame, positions: DataFrame) -> DataFrame:
    """(cell_id, tau, sd, low, high): mean, sd and 90 % interval of time."""
    from brindle.operators.rank import grid_quantile

    p = post.join(positions, "pos")
    m = p.groupBy("cell_id").agg(F.sum(F.col("q") * F.col("t")).alias("tau"), F.sum(F.col("q") * F.col("t") * F.col("t")).alias("tt"))
    low, high = (grid_quantile(p, ["cell_id"], "t", "q", x).withColumnRenamed("position", n) for x, n in ((0.05, "low"), (0.95, "high")))
    sd = F.sqrt(F.greatest(F.col("tt") - F.col("tau") * F.col("tau"), F.lit(0.0)))
    return m.join(low, "cell_id").join(high, "cell_id").select("cell_id", "tau", sd.alias("sd"), "low", "high")


def mass_table(post: DataFrame, least: float = 1e-6) -> DataFrame:
    return post.where(F.col("q") >= least)


def _paths(rates: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels [genes, positions] from rest at log rates [genes, 3] (alpha, beta, gamma)."""
    a, b, g = (np.exp(rates[:, i])[:, None] for i in range(3))
    eb, eg = np.exp(-b * t), np.exp(-g * t)
    gap = g - b
    near = np.abs(gap * t) < 1e-6
    ratio = np.where(near, t * eb, (eb - eg) / np.where(np.abs(gap) < 1e-12, 1e-12, gap))
    return a / b * (1 - eb), np.maximum(a / g * (1 - eg) - a * ratio, 0)


def _log_shares(rates: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, s = (x + 1e-9 for x in _paths(rates, t))
    total = (u + s).sum(0)
    return np.log(u / total), np.log(s / total)


def _climb(state: list, eu: np.ndarray, es: np.ndarray, t: np.ndarray, steps: int, rate: float) -> None:
    """``steps`` of Adam on the log rates for the expected reads at each position; state: rates, both moments, steps taken."""
    x, m, v, step = state
    depth = eu.sum(0) + es.sum(0)

    def loss(r: np.ndarray, level: np.ndarray) -> np.ndarray:
        a, b = _paths(r, t)
        return (level * (a + b) - eu * np.log(a * level + 1e-9) - es * np.log(b * level + 1e-9)).sum(1)

    for _ in range(steps):
        a, b = _paths(x, t)
        level = depth / np.maximum((a + b).sum(0), 1e-9)
        g = np.stack([(loss(x + d, level) - loss(x - d, level)) / 2e-4 for d in 1e-4 * np.eye(3)], 1) / max(depth.sum() / len(x), 1)
        step += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x = np.clip(x, -6, 12)
        x[:, 1] -= x[:, 1].mean()
    state[:] = x, m, v, step


def _start(mean: np.ndarray) -> list:
    """Log rates of genes with these mean reads, and Adam's moments."""
    x = np.zeros((len(mean), 3))
    x[:, 0] = np.log(np.maximum(mean, 1e-3))
    return [x, np.zeros_like(x), np.zeros_like(x), 0]


def _at_places(place: np.ndarray, positions: int) -> np.ndarray:
    """Posterior of groups that lie at these places between 0 and 1."""
    q = np.exp(-0.5 * ((place[:, None] - np.linspace(0, 1, positions)[None, :]) / 0.1) ** 2)
    return q / q.sum(1, keepdims=True)


def _posterior(u: np.ndarray, s: np.ndarray, shares: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
    """Posterior of groups over positions, and their log-likelihood."""
    table = u @ shares[0] + s @ shares[1]
    top = table.max(1, keepdims=True)
    q = np.exp(table - top)
    ll = float((top[:, 0] + np.log(q.sum(1)) - np.log(table.shape[1])).sum())
    return q / q.sum(1, keepdims=True), ll


def fit_rates(u: np.ndarray, s: np.ndarray, t: np.ndarray, rounds: int = 15, steps: int = 40, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray, float]:
    """(log rates [genes, 3], posterior [groups, positions], log-likelihood) of one lineage, groups by genes reads on two tracks.

    Expectation-maximization: the posterior of each group over positions, then Adam on the rates for the expected reads at each
    position. Starts from the leading axis of log unspliced shares, in both directions; beta's mean is held at 1, which fixes the unit of time.
    """
    share = np.log(u + 0.5) - np.log(u + s + 1.0)
    c = share - share.mean(0)
    axis = np.linalg.svd(c, full_matrices=False)[0][:, 0] if len(u) > 1 else np.zeros(1)
    best = None
    for sign in (1.0, -1.0):
        q = _at_places(np.argsort(np.argsort(sign * axis)) / max(len(u) - 1, 1), len(t))
        state, ll = _start((u + s).mean(0)), -np.inf
        for _ in range(rounds):
            _climb(state, u.T @ q, s.T @ q, t, steps, rate)
            q, ll = _posterior(u, s, _log_shares(state[0], t))
        if np.isfinite(ll) and (best is None or ll > best[2]):  # a start that fails never wins
            best = (state[0], q, ll)
    if best is None:
        raise FloatingPointError("no start of the fit is finite")
    return best


#: Genes up to which the leading axis comes from their products; beyond, from passes over the groups.
GENES = 2048


def _leading(rows: DataFrame, blocks, n_genes: int, mean: np.ndarray, n: float) -> np.ndarray:  # noqa: ANN001
    """The genes' leading direction of log unspliced shares about their mean."""

    def centred(u: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.log(u + 0.5) - np.log(u + s + 1.0) - mean

    if n_genes <= GENES:
        g = summed(rows, lambda batches: (c.T @ c for _, u, s in blocks(batches) for c in [centred(u, s)]), n_genes * n_genes)
        return np.linalg.eigh(g.reshape(n_genes, n_genes))[1][:, -1]
    v = np.linalg.qr(np.random.default_rng(0).normal(size=(n_genes, 4)))[0]
    for _ in range(12):
        v = np.linalg.qr(summed(rows, lambda batches, v=v: (c.T @ (c @ v) for _, u, s in blocks(batches) for c in [centred(u, s)]), v.size).reshape(v.shape))[0]
    return v[:, 0]


def fit(tracks: DataFrame, positions: int = 20, span: float = 5.0, rounds: int = 15, steps: int = 40, rate: float = 0.05) -> tuple[DataFrame, DataFrame, float]:
    """(gene, alpha, beta, gamma), (cell_id, pos, q) and the log-likelihood of two-track reads (cell_id: group, gene, u, s).

    The fit of ``fit_rates``, with groups in Spark: each round tasks add up the expected reads of their groups, both directions at
    once, and the driver moves the rates, genes by three. Groups aren't bounded.
    """
    from brindle.operators.rank import placed

    spark = tracks.sparkSession
    t = np.linspace(span / positions, span, positions)
    genes = [r[0] for r in tracks.select("gene").distinct().orderBy("gene").collect()]
    column, n_genes = {g: i for i, g in enumerate(genes)}, len(genes)
    folder = shared_folder(spark, "kinetics")
    packed = tracks.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene", F.col("u").cast("double").alias("u"), F.col("s").cast("double").alias("s")))).alias("x"))
    rows = written(packed.select("cell_id", F.col("x.gene").alias("g"), F.col("x.u").alias("u"), F.col("x.s").alias("s")), folder, "rows")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                u, s = np.zeros((2, len(part), n_genes))
                for i, (g, a, b) in enumerate(zip(part["g"], part["u"], part["s"], strict=True)):
                    to = [column[x] for x in g]
                    u[i, to], s[i, to] = a, b
                yield part, u, s

    first = summed(rows, lambda batches: (np.concatenate([[len(u)], (np.log(u + 0.5) - np.log(u + s + 1.0)).sum(0), (u + s).sum(0)]) for _, u, s in blocks(batches)), 1 + 2 * n_genes)
    n, mean, depth = first[0], first[1 : 1 + n_genes] / max(first[0], 1), first[1 + n_genes :] / max(first[0], 1)
    axis = _leading(rows, blocks, n_genes, mean, n)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, u, s in blocks(batches):
            yield pd.DataFrame({"cell_id": part["cell_id"].to_numpy(), "axis": (np.log(u + 0.5) - np.log(u + s + 1.0) - mean) @ axis})

    key = dict(tracks.dtypes)["cell_id"]
    place = placed(rows.mapInPandas(projected, f"cell_id {key}, axis double"), "axis", "cell_id").select("cell_id", (F.col("__place") / F.greatest(F.col("__n") - 1, F.lit(1))).alias("place"))
    rows = written(rows.join(place, "cell_id"), folder, "placed")
    size = n_genes * positions

    def expected(shares: list | None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            for part, u, s in blocks(batches):
                at = part["place"].to_numpy()
                got = [(_at_places(x, positions), 0.0) for x in (at, 1 - at)] if shares is None else [_posterior(u, s, x) for x in shares]
                yield np.concatenate([np.concatenate([[ll], (u.T @ q).ravel(), (s.T @ q).ravel()]) for q, ll in got])

        flat = summed(rows, run, 2 * (1 + 2 * size)).reshape(2, -1)
        return [(f[0], f[1 : 1 + size].reshape(n_genes, positions), f[1 + size :].reshape(n_genes, positions)) for f in flat]

    states, sums = [_start(depth) for _ in range(2)], expected(None)
    for _ in range(rounds):
        for state, (_, eu, es) in zip(states, sums, strict=True):
            _climb(state, eu, es, t, steps, rate)
        sums = expected([_log_shares(state[0], t) for state in states])
    fits = [(ll, i) for i, (ll, _, _) in enumerate(sums) if np.isfinite(ll)]  # a start that fails never wins
    if not fits:
        raise FloatingPointError("no start of the fit is finite")
    ll, i = max(fits, key=lambda f: (f[0], -f[1]))
    x = states[i][0]
    shares = _log_shares(x, t)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, u, s in blocks(batches):
            yield pd.DataFrame({"cell_id": np.repeat(part["cell_id"].to_numpy(), positions), "pos": np.tile(np.arange(positions), len(part)), "q": _posterior(u, s, shares)[0].ravel()})

    rates = spark.createDataFrame([(g, *map(float, np.exp(r))) for g, r in zip(genes, x, strict=True)], "gene string, alpha double, beta double, gamma double")
    return rates, rows.mapInPandas(read, f"cell_id {key}, pos int, q double"), ll
