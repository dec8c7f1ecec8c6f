"""Starting a fit from an earlier one: pinned rows, gathered rows, progressive epochs, posterior draws, anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preset_rows(table: DataFrame, features: DataFrame, mode: str) -> DataFrame:
    """(feature_id, vec, mode): rows of an earlier table for features of the same key; others have none. mode: freeze, init or lora."""
    from brindle.functions.names import match_key

    if mode not in ("freeze", "init", "lora"):
        raise ValueError(f"unknown mode {mode}")
    old = table.groupBy(match_key("name").alias("key")).agg(F.min_by("vec", "name").alias("vec"))
    return features.withColumn("key", match_key("name")).join(old, "key").select("feature_id", "vec", F.lit(mode).alias("mode"))


def gathered(features: DataFrame, known: DataFrame, groups: DataFrame) -> DataFrame:
    """(feature_id, vec): the known row; else the mean of known rows of its coarse group; else of all.

    ``known``: feature_id, vec; ``groups``: feature_id, grp.
    """
    from brindle.operators.aggregate import vector_mean

    k = known.join(groups, "feature_id")
    by = vector_mean(k, ["grp"]).select("grp", F.col("mean").alias("g"))
    everything = vector_mean(known.withColumn("all", F.lit(0)), ["all"]).select(F.col("mean").alias("a"))
    f = features.select("feature_id").join(groups, "feature_id", "left").join(known, "feature_id", "left").join(by, "grp", "left").crossJoin(F.broadcast(everything))
    return f.select("feature_id", F.coalesce("vec", "g", "a").alias("vec"))


def progressive_epochs(total: int, levels: int) -> list[int]:
    """Epochs of each level, coarsest first: shares by ``levels - i``, one at least."""
    weights = [levels - i for i in range(levels)]
    return [max(1, total * w // sum(weights)) for w in weights]


def gamma_draws(sums: DataFrame, sizes: DataFrame, shape: float = 1.0, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """(pb, feature_id, mean, draw) of the Gamma posterior of rates; each group's draws are seeded by its id.

    ``sums``: pb: long, feature_id, total; ``sizes``: pb, n_cells.
    """
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature_id")
        rng = np.random.default_rng([seed, int(key[0])])
        a, b = shape + pdf["total"].to_numpy(float), rate + float(pdf["n_cells"].iloc[0])
        return pd.DataFrame({"pb": pdf["pb"], "feature_id": pdf["feature_id"], "mean": a / b, "draw": rng.gamma(a, 1 / b)})

    return sums.join(sizes, "pb").select(F.col("pb").cast("long").alias("pb"), F.col("feature_id").cast("long").alias("feature_id"), "total", "n_cells").groupBy("pb").applyInPandas(run, "pb long, feature_id long, mean double, draw double")


def anchor_prior(profiles: np.ndarray, anchors: list[int], temperature: float = 1.0) -> np.ndarray:
    """[groups, anchors]: softmax of the similarity of z-scored log profiles to the anchors' profiles."""
    x = np.log1p(profiles)
    sd = x.std(0)
    z = np.where(sd > 1e-12, (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1), 0)
    z /= np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-12)
    s = z @ z[anchors].T / temperature
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def block_model(w: np.ndarray, depth: int = 3, passes: int = 50, seed: int = 0) -> np.ndarray:
    """Leaves of a hierarchical block model, ``2 ** (depth - 1)`` of them, by a spectral sweep cut and greedy moves at each split."""
    del seed
    leaf = np.zeros(len(w), int)
    for _ in range(depth - 1):
        new = leaf * 2
        for k in np.unique(leaf):
            at = np.flatnonzero(leaf == k)
            if len(at) < 2:
                continue
            a = w[np.ix_(at, at)]
            d = np.maximum(a.sum(1), 1e-12)
            _, v = np.linalg.eigh(a / np.sqrt(d[:, None] * d[None, :]))
            # the place along the second eigenvector where the normalized cut is least
            order = np.argsort(v[:, -2] / np.sqrt(d), kind="stable")
            b, total = a[np.ix_(order, order)], d.sum()
            inner = np.cumsum([b[i, :i].sum() * 2 + b[i, i] for i in range(len(at))])
            size = np.cumsum(d[order])
            cut = (size - inner)[:-1]
            at_best = int((cut / np.maximum(np.minimum(size[:-1], total - size[:-1]), 1e-12)).argmin())
            side = np.ones(len(at), int)
            side[order[: at_best + 1]] = 0
            for _ in range(passes):
                gain = np.zeros(len(at))
                for s in (0, 1):
                    here = side == s
                    inside, outside = a @ here, a @ ~here
                    gain[here] = (outside - d * d[~here].sum() / total)[here] - (inside - d * (d[here].sum() - d) / total)[here]
                best = int(gain.argmax())
                if gain[best] <= 1e-9 or (side == side[best]).sum() == 1:
                    break
                side[best] ^= 1
            new[at] += side
        leaf = new
    return leaf


def kmeans_seeds(x: np.ndarray, weight: np.ndarray, k: int, seed: int = 0) -> list[int]:
    """Rows by k-means++: each next one with chances weight times squared distance to the nearest so far."""
    rng = np.random.default_rng(seed)
    found = [int(rng.choice(len(x), p=weight / weight.sum()))]
    d = ((x - x[found[0]]) ** 2).sum(1)
    while len(found) < min(k, len(x)):
        p = weight * d
        found.append(int(p.argmax()) if p.sum() <= 0 else int(rng.choice(len(x), p=p / p.sum())))
        d = np.minimum(d, ((x - x[found[-1]]) ** 2).sum(1))
    return found


def committee(models: list[str], own: str, size: int, seed: int = 0) -> list[str]:
    """``size`` other models, all if there are no more, by a draw of their own for each model."""
    import zlib

    others = sorted(m for m in models if m != own)
    rng = np.random.default_rng([seed, zlib.crc32(own.encode())])
    return sorted(rng.choice(others, size, replace=False).tolist()) if 0 < size < len(others) else others


def selection_rules(n_files: int, multiome: bool | None, top: int) -> tuple[bool, int]:
    """(multiome, features to select): one file is no multiome, and a multiome selects none."""
    multi = bool(multiome) and n_files > 1
    return multi, 0 if multi else top
