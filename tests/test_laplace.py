"""The path prior, banded factors, and splicing rates at their mode: definitions, recovery from a wrong start, bounds."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.operators import laplace
from brindle.operators.laplace import Band, GridPrior, Prior


def test_covariance_hangs_on_the_length_over_the_span_only():
    assert np.allclose(laplace.grid_covariance(21, 1.0, 0.25), laplace.grid_covariance(21, 8.0, 2.0), atol=1e-12)
    row = laplace.grid_covariance(6, 1.5, 0.3)[0]
    assert row[0] == pytest.approx(1.0, abs=1e-7) and (np.diff(row) < 0).all() and row[-1] < 1e-3


def test_draws_have_the_covariance_and_whitening_goes_back():
    prior = GridPrior(9, 2.0, 0.6)
    z = prior.colour(np.random.default_rng(3).normal(size=(9, 40_000)))
    assert np.abs(z @ z.T / 40_000 - laplace.grid_covariance(9, 2.0, 0.6)).max() < 0.03
    fine = GridPrior(65, 1.0, 0.05)
    eta = np.sin(0.37 * np.arange(65))
    assert np.abs(fine.whiten(fine.colour(eta)) - eta).max() < 1e-6
    scale = np.ones(65)
    assert np.abs(fine.whiten_scaled(scale, fine.colour(eta), 1e-6) - eta).max() < 1e-3
    scale[:10] = 0
    assert np.isfinite(fine.whiten_scaled(scale, scale * fine.colour(eta), 1e-3)).all()


@pytest.mark.parametrize("width", [0, 2, 5])
def test_bands_equal_dense_matrices(width):
    rng = np.random.default_rng(width)
    a = rng.normal(size=(9, 9)) * (np.abs(np.subtract.outer(range(9), range(9))) <= width)
    m = a @ a.T
    m *= np.abs(np.subtract.outer(range(9), range(9))) <= width
    m += 12 * np.eye(9)
    l = Band.of(m, width).cholesky()
    dense = np.linalg.cholesky(m)
    assert np.allclose(Band.of(dense, width, lower=True).rows, l.rows)
    b = rng.normal(size=9)
    assert np.allclose(l.solve(b), np.linalg.solve(m, b)) and l.log_det() == pytest.approx(np.linalg.slogdet(m)[1])
    assert np.allclose(l.solve(np.eye(9)), np.linalg.inv(m))


def test_guard_takes_the_least_ridge_that_works():
    assert Band.of(np.diag([1.0, -1.0])).cholesky() is None
    l, ridge = Band.of(np.ones((3, 3))).guarded()
    assert 0 < ridge < 1e-6 and np.isfinite(l.rows).all()
    assert Band.of(np.eye(3)).guarded()[1] == 0.0
    with pytest.raises(FloatingPointError):
        Band.of(np.diag([np.nan, 1.0])).guarded()


def test_levels_follow_the_equations():
    t = np.linspace(0, 6, 400)
    beta, gamma, alpha = 1.3, 1.3 + 1e-9, np.exp(0.4 * np.sin(t))
    u, s = laplace.levels(np.log([beta]), np.log([gamma]), np.log(alpha)[None], t)
    x, y = alpha[0] / beta, alpha[0] / gamma
    fine = np.linspace(0, 6, 40_000)
    for a in np.interp(fine[:-1], t, alpha):
        h = fine[1]
        x, y = x + h * (a - beta * x), y + h * (beta * x - gamma * y)
    assert u[0, -1] == pytest.approx(x, rel=1e-3) and s[0, -1] == pytest.approx(y, rel=1e-3)


def simulated(genes=60, n=45, depth=300.0, seed=0):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 8, n)
    z = np.column_stack([np.sin(t / 2), np.cos(t / 3)])
    log_gamma, log_ratio = rng.normal(0.0, 0.4, genes), rng.normal(np.log(0.6), 0.3, genes)
    lo, hi = laplace.bounds_of(t)
    log_gamma = np.clip(log_gamma, lo + 0.3, hi - 0.3)
    log_ratio = log_gamma - np.clip(log_gamma - log_ratio, lo + 0.3, hi - 0.3)
    rho = rng.normal(0, 1, (genes, 2))
    level = rng.normal(0, 0.5, genes)
    lu, ls = laplace.levels(log_gamma - log_ratio, log_gamma, level[:, None] + log_gamma[:, None] + rho @ (z - z.mean(0)).T, t)
    e = rng.uniform(0.5, 1.5, n) * depth
    return t, z, e, rng.poisson(lu * e), rng.poisson(ls * e), log_gamma, log_ratio, rho


@pytest.mark.parametrize("bounded", [False, True])
def test_rates_are_found_from_the_prior_mean(bounded):
    t, z, e, u, s, log_gamma, log_ratio, rho = simulated()
    prior = Prior(bounds=laplace.bounds_of(t) if bounded else None)
    got = laplace.modes(u, s, e, t, z, prior)
    assert got["settled"].mean() > 0.95
    off = np.abs(got["log_gamma"] - log_gamma) / np.maximum(got["sd_log_gamma"], 1e-3)
    steady = np.abs(got["log_gamma"] - got["log_beta"] - log_ratio) / np.maximum(got["sd_log_ratio"], 1e-3)
    assert np.mean(off < 3) > 0.95 and np.mean(steady < 3) > 0.95 and np.median(off) < 1.2
    assert np.quantile(np.abs(got["log_gamma"] - got["log_beta"] - log_ratio)[(u + s).sum(1) > 20_000], 0.95) < 0.05
    assert np.corrcoef(got["rho"].ravel(), rho.ravel())[0, 1] > 0.97


def test_modes_are_modes():
    t, z, e, u, s, *_ = simulated(4, depth=40.0)
    got = laplace.modes(u, s, e, t, z, Prior())
    for k in ("log_gamma", "log_beta"):
        for d in (-0.3, 0.3):
            moved = {n: v.copy() for n, v in got.items()}
            moved[k] = moved[k] + d
            lu, ls = laplace.levels(moved["log_beta"], moved["log_gamma"], moved["base"][:, None] + moved["rho"] @ z.T, t)
            p = Prior()
            spliced = moved["base"] + moved["rho"] @ z.mean(0) - moved["log_gamma"]
            pulls = ((moved["log_gamma"] - p.log_gamma[0]) / p.log_gamma[1]) ** 2 + ((moved["log_gamma"] - moved["log_beta"] - p.log_ratio[0]) / p.log_ratio[1]) ** 2 + (moved["rho"] ** 2).sum(1) + ((spliced - p.log_spliced[0]) / p.log_spliced[1]) ** 2
            assert ((u * np.log(lu * e) - lu * e + s * np.log(ls * e) - ls * e).sum(1) - pulls / 2 < got["objective"] + 1e-6).all()


def test_unresolved_rates_stay_inside_their_bounds():
    t, z, e, *_ = simulated(1)
    lo, hi = laplace.bounds_of(t)
    for log_gamma in (hi + 3, lo - 3):
        lu, ls = laplace.levels(np.array([log_gamma + 0.7]), np.array([log_gamma]), (log_gamma + z[:, 0])[None], t)
        got = laplace.modes(lu * e, ls * e, e, t, z, Prior(bounds=(lo, hi)))
        assert lo <= got["log_gamma"][0] <= hi and lo <= got["log_beta"][0] <= hi


def test_features_in_spark(spark):
    t, z, e, u, s, log_gamma, log_ratio, _ = simulated(12)
    reads = spark.createDataFrame([(f"g{f}", j, float(u[f, j]), float(s[f, j])) for f in range(12) for j in range(45)] + [("silent", 0, 0.0, 0.0)], "gene string, pos int, u double, s double")
    exposure = spark.createDataFrame([(j, float(x)) for j, x in enumerate(e)], "pos int, exposure double")
    paths = spark.createDataFrame([(j, float(t[j]), [float(x) for x in z[j]]) for j in range(45)], "pos int, t double, z array<double>")
    got = {r.gene: r for r in laplace.feature_rates(reads, exposure, paths).collect()}
    assert len(got) == 13 and not got["silent"].settled
    assert all(abs(got[f"g{f}"].log_gamma - got[f"g{f}"].log_beta - log_ratio[f]) < 4 * got[f"g{f}"].sd_log_ratio + 1e-3 for f in range(12))
