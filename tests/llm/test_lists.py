"""Lists of one value, of two and of three: which are made, and that none loses a link."""

from __future__ import annotations

import random

import pytest

from brindle.llm import minhash
from tests.llm.test_methods import brute


def _texts(seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(40)}" for _ in range(60)]
    texts = {}
    for i in range(120):
        t = list(base) if i < 30 else [f"w{min(int(rng.expovariate(0.2)), 39)}" for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(99)}"
        texts[i] = " ".join(t)
    return texts


def test_lists_that_one_task_can_try_are_not_refined(spark, monkeypatch):
    """Common values whose lists are short enough make no pairs of values: their number was up to 40 a class."""
    made, counted = {}, minhash._counted

    def watched(rows, name):
        made[name] = counted(rows, name)
        return made[name]

    monkeypatch.setattr(minhash, "_counted", watched)
    monkeypatch.setattr(minhash, "LISTS", (2, 2048, 4096))
    texts = _texts(1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == brute(texts, 2, 80)
    assert made["mixed"].count() > 0 and made["postings2"].count() == 0


@pytest.mark.parametrize("direct", [2, 6, 20])
def test_longer_lists_are_refined_without_loss(spark, monkeypatch, direct):
    monkeypatch.setattr(minhash, "LISTS", (2, 3, 4))
    monkeypatch.setattr(minhash, "DIRECT", direct)
    texts = _texts(direct)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == brute(texts, 2, 80)
