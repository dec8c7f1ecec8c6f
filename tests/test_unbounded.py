"""What took a bounded table before: any number of groups, and the same results on few."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.operators import kinetics, mixtures, score, view


def _tracks(spark, n, genes=6, seed=3):
    rng = np.random.default_rng(seed)
    u, s = rng.poisson(3.0, (n, genes)), rng.poisson(5.0, (n, genes))
    rows = [(i, f"g{j}", int(u[i, j]), int(s[i, j])) for i in range(n) for j in range(genes)]
    return spark.createDataFrame(rows, "cell_id long, gene string, u long, s long"), u.astype(float), s.astype(float)


def test_kinetics_take_any_number_of_groups(spark):
    tracks, *_ = _tracks(spark, 4200, 2)
    rates, post, ll = kinetics.fit(tracks, positions=4, rounds=1, steps=2)
    assert rates.count() == 2 and post.count() == 4 * 4200 and np.isfinite(ll)


@pytest.mark.parametrize("genes", [6, 1])
def test_kinetics_in_spark_equal_the_bounded_fit(spark, genes):
    tracks, u, s = _tracks(spark, 30, genes)
    t = np.linspace(1.25, 5.0, 4)
    x, q, ll = kinetics.fit_rates(u, s, t, rounds=3, steps=5)
    rates, post, got = kinetics.fit(tracks, positions=4, rounds=3, steps=5)
    assert np.isclose(got, ll)
    assert np.allclose(rates.orderBy("gene").toPandas()[["alpha", "beta", "gamma"]], np.exp(x), rtol=1e-3)
    assert np.allclose(post.orderBy("cell_id", "pos").toPandas()["q"].to_numpy().reshape(30, 4), q, atol=1e-3)


def test_more_equal_vectors_than_a_block_keeps(spark):
    # twenty copies and one other: each point's two nearest are the copies of the lowest ids
    points = spark.createDataFrame([(i, [0.0, 2.0]) for i in range(20)] + [(20, [1.0, 0.1])], "id long, vec array<double>")
    got = {}
    for a, b, c in sorted(tuple(r) for r in view.near(points, points, 2, same=True).collect()):
        got.setdefault(a, []).append((b, c))
    assert [b for b, _ in got[0]] == [1, 2] and [b for b, _ in got[1]] == [0, 2] and [b for b, _ in got[7]] == [0, 1] and all(c == 1.0 for _, c in got[7])
    assert [b for b, _ in got[20]] == [0, 1]


def test_topic_rates_shuffle_no_pairs(spark):
    theta = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0), (3, 2, 1.0)], "cell_id long, k int, theta double")
    beta = spark.createDataFrame([(7, 0, 0.0), (7, 1, 1.0), (8, 0, -1.0)], "feature_id long, k int, beta double")
    r = score.topic_rates(theta, beta)
    got = {(a, b): v for a, b, v in r.collect()}
    assert set(got) == {(1, 7), (1, 8), (2, 7)}
    assert np.allclose([got[1, 7], got[1, 8], got[2, 7]], [0.5 + 0.5 * np.e, 0.5 / np.e, np.e])
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Aggregate")


def test_profiles_do_not_pass_through_the_driver(spark, monkeypatch):
    profiles = spark.createDataFrame([(n, g, float(1 + (g + i) % 3)) for i, n in enumerate("ab") for g in range(40)], "label string, feature_id long, rate double")
    bulk = spark.createDataFrame([(s, g, float(3 + g % 4)) for s in (1, 2) for g in range(0, 60, 2)], "sample long, feature_id long, value double")
    monkeypatch.setattr(type(profiles), "toPandas", lambda self: pytest.fail("a table came to the driver"))
    draws = mixtures.gibbs(bulk, profiles, warmup=5, draws=5, dispersion=10.0).collect()
    assert len(draws) == 2 * 2 * 5 * 2 and all(r["u"] > 0 for r in draws)
    split = {}
    for r in mixtures.expression(bulk, profiles, warmup=5, draws=5).collect():
        split[r["sample"], r["feature_id"]] = split.get((r["sample"], r["feature_id"]), 0.0) + r["value"]
    assert len(split) == 40 and all(abs(v - (3 + g % 4)) < 1e-9 for (_, g), v in split.items())  # features 40 to 58 have no rates
