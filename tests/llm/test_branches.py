"""Merkle fingerprints by branches: checkable from children, alike by descent, edits located in the query's rows."""

from __future__ import annotations

import random
from collections import Counter

from brindle.llm import merkle


def texts(seed, n=60):
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]
    return lines


def test_every_branch_is_checked_by_its_children_alone():
    fp = merkle.fingerprint("\n".join(texts(1)))
    assert merkle.verified(fp) and merkle.verified(merkle.fingerprint("")) and merkle.verified(merkle.fingerprint(None))
    rnd = random.Random(2)
    for _ in range(60):
        i = rnd.randrange(len(fp))
        if fp[i] in "0123456789abcdef":
            other = rnd.choice([c for c in "0123456789abcdef" if c != fp[i]])
            assert not merkle.verified(fp[:i] + other + fp[i + 1 :])


def test_likeness_by_descent_is_that_of_all_leaves():
    """Equal branches count whole, as if all their leaves were met one by one."""
    every = lambda fp: Counter(leaf for _, s in merkle.sections_of(fp) for _, p in s for leaf in p.split(",") if leaf)
    weigh = lambda c: sum(n * int(k.partition("-")[0], 16) for k, n in c.items())
    rnd = random.Random(3)
    for seed in range(25):
        a = texts(seed)
        b = list(a)
        for _ in range(rnd.randrange(0, 12)):
            b[rnd.randrange(len(b))] = " ".join(rnd.choice(["new", "words", "alpha"]) for _ in range(9))
        if rnd.random() < 0.3:
            b = b[10:] + b[:10]
        x, y = merkle.fingerprint("\n".join(a)), merkle.fingerprint("\n".join(b))
        got, one, two = merkle.likeness(x, y), every(x), every(y)
        want = 2 * weigh(one & two) / (weigh(one) + weigh(two))
        assert got == merkle.likeness(y, x) and abs(got - want) < 0.02 and got <= want + 1e-12


def test_edits_are_located_in_the_rows(spark):
    long = "\n".join(f"Paragraph {i} says that number {i} is as good as any." for i in range(90))
    rows = {r.doc_id: r for r in merkle.fingerprints(spark.createDataFrame([(2, long), (1, "other text\n" * 40)], "doc_id long, text string")).collect()}
    fp = rows[2].edited_fingerprint
    told = [tuple(map(int, x.split("."))) for x in rows[2].edits.split(",")]
    assert told == merkle.differences(rows[2].fingerprint, fp)
    order = [(i, j) for i, (_, s) in enumerate(merkle.sections_of(fp)) for j in range(len(s))]
    # only paragraphs of the last third
    assert min(order.index(x) for x in told) >= 55
    same = merkle.fingerprints(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()
    assert same.edits == "" and same.near_next == 1.0
