"""Paths with a smooth prior, and each feature's splicing rates at their mode with deviations.

The prior of a path on a grid is Gaussian with a Matérn-5/2 covariance; its Cholesky factor colours and whitens. Given the paths,
features are independent: each has its synthesis ``alpha(t) = exp(base + rho . z(t))``, splicing beta and decay gamma, and reads
that are Poisson around exposure times level at each position. A feature's mode is sought by damped Gauss-Newton steps on its own
summed reads, many features at a time in a task; deviations are those of the Gaussian at the mode (Laplace).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to a covariance's diagonal; positions of a grid at most; features that a task fits at once; steps of a fit.
JITTER, POSITIONS, FEATURES, STEPS = 1e-8, 512, 512, 60


def grid_covariance(n: int, span: float, length: float) -> np.ndarray:
    """Matérn-5/2 correlation of ``n`` even positions over ``span``, jitter on the diagonal."""
    t = np.linspace(0.0, span, n) if n > 1 else np.zeros(1)
    r = np.sqrt(5.0) * np.abs(t[:, None] - t[None, :]) / length
    return (1 + r + r * r / 3) * np.exp(-r) + JITTER * np.eye(n)


class GridPrior:
    """The prior of a path on a grid: ``z = C eta`` with independent standard normal eta."""

    def __init__(self, n: int, span: float, length: float):
        if n > POSITIONS:
            raise ValueError(f"more than {POSITIONS} positions")
        self.chol, self.share = np.linalg.cholesky(grid_covariance(n, span, length)), length / span

    def colour(self, eta: np.ndarray) -> np.ndarray:
        return self.chol @ eta

    def whiten(self, z: np.ndarray) -> np.ndarray:
        return Band.of(self.chol, lower=True).forward(z)

    def whiten_scaled(self, scale: np.ndarray, z: np.ndarray, error: float) -> np.ndarray:
        """The likeliest eta where ``z`` is ``scale * (C eta)`` to within ``error``; positions of scale 0 say nothing."""
        a = scale[:, None] * self.chol
        return np.linalg.solve(a.T @ a / error**2 + np.eye(len(z)), a.T @ z / error**2)


class Band:
    """A symmetric matrix, or a lower factor, as its diagonals: ``rows[k, i]`` is the entry (i + k, i)."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.width, self.n = rows, len(rows) - 1, rows.shape[1]

    @classmethod
    def of(cls, m: np.ndarray, width: int | None = None, lower: bool = False) -> Band:
        n = len(m)
        width = n - 1 if width is None else min(width, n - 1)
        s = m if lower else 0.5 * (m + m.T)
        rows = np.zeros((width + 1, n))
        for k in range(width + 1):
            rows[k, : n - k] = np.diagonal(s, -k)
        return cls(rows)

    def cholesky(self) -> Band | None:
        """The lower factor, of the same width; None where a pivot isn't positive and finite."""
        l = self.rows.copy()
        for j in range(self.n):
            d = l[0, j]
            if not (d > 0 and np.isfinite(d)):
                return None
            l[0, j] = np.sqrt(d)
            m = min(self.width, self.n - 1 - j)
            l[1 : m + 1, j] /= l[0, j]
            c = l[1 : m + 1, j]
            for k in range(m):  # what column j takes from the columns after it
                l[: m - k, j + 1 + k] -= c[k] * c[k:]
        return Band(l)

    def guarded(self) -> tuple[Band, float]:
        """A factor, and the ridge on the diagonal that it took: none, or from 1e-10 of the mean diagonal up by tens."""
        ridge, size = 0.0, max(float(np.abs(self.rows[0]).mean()), 1e-300) if self.n else 1.0
        while True:
            r = self.rows.copy()
            r[0] += ridge
            if (l := Band(r).cholesky()) is not None:
                return l, ridge
            if not np.isfinite(self.rows).all() or ridge > 1e10 * size:
                raise FloatingPointError("the matrix isn't finite")
            ridge = max(ridge * 10, 1e-10 * size)

    def forward(self, b: np.ndarray) -> np.ndarray:
        """``L x = b``."""
        x = np.array(b, float)
        for i in range(self.n):
            x[i] /= self.rows[0, i]
            m = min(self.width, self.n - 1 - i)
            x[i + 1 : i + 1 + m] -= np.multiply.outer(self.rows[1 : m + 1, i], x[i])
        return x

    def backward(self, b: np.ndarray) -> np.ndarray:
        """``L' x = b``."""
        x = np.array(b, float)
        for i in range(self.n - 1, -1, -1):
            m = min(self.width, self.n - 1 - i)
            x[i] = (x[i] - self.rows[1 : m + 1, i] @ x[i + 1 : i + 1 + m]) / self.rows[0, i]
        return x

    def solve(self, b: np.ndarray) -> np.ndarray:
        """``L L' x = b``."""
        return self.backward(self.forward(b))

    def log_det(self) -> float:
        """Of ``L L'``."""
        return float(2 * np.log(self.rows[0]).sum())


class Prior(NamedTuple):
    """Mean and deviation of log gamma, log gamma / beta, and the mean log spliced level; deviation of rho; bounds of both log rates."""

    log_gamma: tuple[float, float] = (float(np.log(2.0)), 1.5)
    log_ratio: tuple[float, float] = (float(np.log(0.5)), 1.0)
    rho: float = 1.0
    log_spliced: tuple[float, float] = (0.0, 1.5)
    bounds: tuple[float, float] | None = None


def bounds_of(t: np.ndarray) -> tuple[float, float]:
    """Log rates whose half-lives lie between one step of the grid and four spans: beyond, reads don't tell."""
    span = float(t[-1] - t[0])
    return float(np.log(np.log(2.0) / (4.0 * span))), float(np.log(np.log(2.0) / (span / max(len(t) - 1, 1))))


def levels(log_beta: np.ndarray, log_gamma: np.ndarray, log_alpha: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unspliced and spliced levels [features, positions], from the steady state at the first position; synthesis [features, positions] is held at the mean of a step's ends."""
    beta, gamma, alpha = np.exp(log_beta), np.exp(log_gamma), np.exp(log_alpha)
    u, s = np.empty_like(alpha), np.empty_like(alpha)
    u[:, 0], s[:, 0] = alpha[:, 0] / beta, alpha[:, 0] / gamma
    for j in range(1, alpha.shape[1]):
        h, a = t[j] - t[j - 1], 0.5 * (alpha[:, j] + alpha[:, j - 1])
        eb, eg, gap = np.exp(-beta * h), np.exp(-gamma * h), (gamma - beta) * h
        near = np.abs(gap) < 1e-6
        # (exp(-bh) - exp(-gh)) / (g - b)
        ratio = h * np.where(near, eb * (1 - gap / 2), (eb - eg) / np.where(near, 1.0, gap))
        u[:, j] = u[:, j - 1] * eb + a / beta * (1 - eb)
        s[:, j] = s[:, j - 1] * eg + a / gamma * (1 - eg) + (beta * u[:, j - 1] - a) * ratio
    return np.maximum(u, 1e-300), np.maximum(s, 1e-300)


def _values(x: np.ndarray, prior: Prior) -> tuple[np.ndarray, np.ndarray]:
    """log gamma and log beta of coordinates [features, 2 + H + 1]; with bounds the first two run along a logistic curve between them."""
    if prior.bounds is None:
        return x[:, 0], x[:, 0] - x[:, 1]
    lo, hi = prior.bounds
    g, b = (lo + (hi - lo) / (1 + np.exp(-np.clip(c, -40, 40))) for c in (x[:, 0], x[:, 1]))
    return g, b


def _start(rows: int, h: int, prior: Prior) -> np.ndarray:
    x = np.zeros((rows, h + 3))
    x[:, 0], x[:, 1], x[:, -1] = prior.log_gamma[0], prior.log_ratio[0], prior.log_spliced[0]
    if prior.bounds is not None:
        lo, hi = prior.bounds
        back = lambda v: np.log(p := np.clip((v - lo) / (hi - lo), 0.02, 0.98)) - np.log(1 - p)
        x[:, 0], x[:, 1] = back(prior.log_gamma[0]), back(prior.log_gamma[0] - prior.log_ratio[0])
    return x


def modes(u: np.ndarray, s: np.ndarray, exposure: np.ndarray, t: np.ndarray, z: np.ndarray, prior: Prior, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Mode and deviations of features with reads ``u`` and ``s`` [features, positions] under ``exposure`` [positions] and paths ``z`` [positions, H].

    Coordinates are log gamma, log gamma / beta, rho and the mean log spliced level, in which speed, steady state and shape barely trade.
    """
    rows, h = len(u), z.shape[1]
    centred = z - z.mean(0)
    x = _start(rows, h, prior)
    # the level starts where the reads are
    x[:, -1] = np.log((s.sum(1) + 0.5) / max(exposure.sum(), 1e-300))
    logs = (u + s).sum(1) > 0

    def predicted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, b = _values(x, prior)
        level = x[:, -1:] + g[:, None] + x[:, 2 : 2 + h] @ centred.T
        lu, ls = levels(b[:, None][:, 0], g, level, t)
        pulls = np.column_stack([(g - prior.log_gamma[0]) / prior.log_gamma[1], (g - b - prior.log_ratio[0]) / prior.log_ratio[1], x[:, 2 : 2 + h] / prior.rho, (x[:, -1] - prior.log_spliced[0]) / prior.log_spliced[1]])
        return lu * exposure, ls * exposure, pulls

    def score(x: np.ndarray) -> np.ndarray:
        mu, ms, pulls = predicted(x)
        mu, ms = np.maximum(mu, 1e-300), np.maximum(ms, 1e-300)
        return (u * np.log(mu) - mu + s * np.log(ms) - ms).sum(1) - 0.5 * (pulls**2).sum(1)

    def slopes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and expected curvature of each feature."""
        mu, ms, pulls = predicted(x)
        wide = np.concatenate([mu, ms, pulls], 1)
        k = x.shape[1]
        jac = np.empty((rows, wide.shape[1], k))
        for i in range(k):
            e = np.zeros(k)
            e[i] = 1e-5
            jac[:, :, i] = (np.concatenate(predicted(x + e), 1) - np.concatenate(predicted(x - e), 1)) / 2e-5
        m = 2 * len(t)
        mean, read = np.maximum(wide[:, :m], 1e-12), np.concatenate([u, s], 1)
        grad = np.einsum("fpk,fp->fk", jac[:, :m], read / mean - 1) - np.einsum("fpk,fp->fk", jac[:, m:], pulls)
        curve = np.einsum("fpk,fpl->fkl", jac[:, :m] / mean[:, :, None], jac[:, :m]) + np.einsum("fpk,fpl->fkl", jac[:, m:], jac[:, m:])
        return grad, curve

    now, damp, settled = score(x), np.full(rows, 1e-3), np.zeros(rows, bool)
    for _ in range(steps):
        grad, curve = slopes(x)
        diagonal = np.einsum("fkk->fk", curve)
        step = np.stack([Band.of(curve[f] + np.diag(damp[f] * (diagonal[f] + 1e-12))).guarded()[0].solve(grad[f]) for f in range(rows)]) if rows else x
        step = np.clip(step, -2, 2)
        new = score(x + step)
        better = np.isfinite(new) & (new >= now) & ~settled
        settled |= np.abs(new - now) < 1e-9 * (1 + np.abs(now))
        x = np.where(better[:, None], x + step, x)
        now = np.where(better, new, now)
        damp = np.where(better, damp / 5, damp * 5)
        if settled.all():
            break
    _, curve = slopes(x)
    g, b = _values(x, prior)
    sd_gamma, sd_ratio = np.empty(rows), np.empty(rows)
    for f in range(rows):
        jac = np.zeros((2, x.shape[1]))
        for i in range(2):
            e = np.zeros(x.shape[1])
            e[i] = 1e-5
            (ga, ba), (gb, bb) = _values((x[f] + e)[None], prior), _values((x[f] - e)[None], prior)
            jac[:, i] = ((ga - gb)[0] / 2e-5, ((ga - ba) - (gb - bb))[0] / 2e-5)
        cov = jac @ Band.of(curve[f]).guarded()[0].solve(jac.T)
        sd_gamma[f], sd_ratio[f] = np.sqrt(np.maximum(np.diagonal(cov), 0))
    rho = x[:, 2 : 2 + h]
    return {"log_gamma": g, "log_beta": b, "rho": rho, "base": x[:, -1] + g - rho @ z.mean(0), "sd_log_gamma": sd_gamma, "sd_log_ratio": sd_ratio, "objective": now, "settled": settled & logs}


def position_reads(tracks: DataFrame, posterior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene, pos, u, s) expected reads at each position, and (pos, exposure): counts of cells (cell_id, gene, u, s) dealt by (cell_id, pos, q)."""
    reads = tracks.join(posterior, "cell_id").groupBy("gene", "pos").agg(F.sum(F.col("u") * F.col("q")).alias("u"), F.sum(F.col("s") * F.col("q")).alias("s"))
    depth = tracks.groupBy("cell_id").agg(F.sum(F.col("u") + F.col("s")).alias("depth"))
    return reads, depth.join(posterior, "cell_id").groupBy("pos").agg(F.sum(F.col("depth") * F.col("q")).alias("exposure"))


def feature_rates(reads: DataFrame, exposure: DataFrame, paths: DataFrame, prior: Prior | None = None) -> DataFrame:
    """(gene, log_gamma, log_beta, rho, base, sd_log_gamma, sd_log_ratio, objective, settled) of reads (gene, pos, u, s).

    ``exposure``: pos, exposure, scaled here to a mean of 1 a feature; ``paths``: pos, t, z; both ``POSITIONS`` rows at most. A gene without reads is at its prior, unsettled.
    """
    p = paths.join(exposure, "pos", "left").orderBy("pos").limit(POSITIONS + 1).toPandas()
    if len(p) > POSITIONS:
        raise ValueError(f"more than {POSITIONS} positions")
    t, z = p["t"].to_numpy(float), np.array(p["z"].tolist(), float).reshape(len(p), -1)
    e = p["exposure"].fillna(0.0).to_numpy(float)
    e = e / max(e.mean(), 1e-300)
    place = {k: i for i, k in enumerate(p["pos"].tolist())}
    prior = prior or Prior(bounds=bounds_of(t))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for at in range(0, len(pdf), FEATURES):
                part = pdf.iloc[at : at + FEATURES]
                u, s = np.zeros((len(part), len(t))), np.zeros((len(part), len(t)))
                for i, (pos, a, b) in enumerate(zip(part["pos"], part["u"], part["s"], strict=True)):
                    k = [place[x] for x in pos.tolist()]
                    u[i, k], s[i, k] = a, b
                got = modes(u, s, e, t, z, prior)
                yield pd.DataFrame({"gene": part["gene"].to_numpy(), **got, "rho": list(got["rho"])})

    per = reads.groupBy("gene").agg(F.collect_list(F.struct("pos", F.col("u").cast("double").alias("u"), F.col("s").cast("double").alias("s"))).alias("x")).select("gene", F.col("x.pos").alias("pos"), F.col("x.u").alias("u"), F.col("x.s").alias("s"))
    schema = f"gene {dict(reads.dtypes)['gene']}, log_gamma double, log_beta double, rho array<double>, base double, sd_log_gamma double, sd_log_ratio double, objective double, settled boolean"
    return per.mapInPandas(run, schema)
