"""Layouts and starts on planted points."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.operators import layout, start


@pytest.fixture(scope="module")
def three():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.3, (25, 5)) for c in (0, 8, -8)]), np.repeat(np.arange(3), 25)


@pytest.mark.parametrize("method", sorted(layout.METHODS))
def test_layouts_keep_groups_together(three, method):
    x, label = three
    y = layout.METHODS[method](x)
    assert y.shape == (75, 2) and np.isfinite(y).all()
    if method != "lle":  # three separate groups have no one local-linear map
        c = np.array([y[label == k].mean(0) for k in range(3)])
        assert (((y[:, None] - c) ** 2).sum(2).argmin(1) == label).mean() > 0.95


def test_matching_and_block_model(three):
    x, label = three
    w = layout.affinity(x)
    group = layout.matching(w, 10)
    assert len(set(group)) == 10 and all(len(set(label[group == g])) == 1 for g in set(group))
    leaves = start.block_model(w, 3)
    assert all(len(set(label[leaves == k])) == 1 for k in set(leaves))


def test_starts():
    assert start.progressive_epochs(100, 3) == [50, 33, 16] and start.progressive_epochs(1, 3) == [1, 1, 1]
    assert start.committee(["a", "b", "c"], "a", 0) == ["b", "c"] and len(start.committee(["a", "b", "c"], "a", 1)) == 1
    assert start.selection_rules(1, True, 9) == (False, 9) and start.selection_rules(2, True, 9) == (True, 0)
    assert len(set(start.kmeans_seeds(np.eye(5), np.ones(5), 5))) == 5
    p = start.anchor_prior(np.random.default_rng(0).random((6, 4)), [0, 3])
    assert np.allclose(p.sum(1), 1) and p[0].argmax() == 0 and p[3].argmax() == 1


def test_a_tree_in_layers():
    """Parents stand a layer above the middle of their children, and no two subtrees of a node overlap."""
    rng = np.random.default_rng(1)
    parent = np.array([-1, *(int(rng.integers(0, i)) for i in range(1, 40))])
    depth = np.zeros(40, int)
    for i in range(1, 40):
        depth[i] = depth[parent[i]] + 1
    y = layout.layered(depth, parent)
    under = [{i} for i in range(40)]
    for i in range(39, 0, -1):
        under[parent[i]] |= under[i]
    for i in range(40):
        kids = [c for c in range(40) if parent[c] == i]
        if kids:
            assert y[i, 0] == pytest.approx(np.mean([y[c, 0] for c in kids])) and all(y[c, 1] == y[i, 1] - 1 for c in kids)
        spans = sorted((min(y[j, 0] for j in under[c]), max(y[j, 0] for j in under[c])) for c in kids)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    x = rng.normal(size=(30, 3))
    assert layout.TREES["layered"](x).shape == (30, 2)
