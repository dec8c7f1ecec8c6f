"""Divergence of sources, conversation trie, pairwise ranking: against brute force, planted cases, held-out rows and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import divergence, pairwise, trie
from tests.conftest import DATA

# trie


def brute_trie(rows):
    """Nodes as the contract words them, from (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    value = {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in members.items()}
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), sum(value[q] for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return [tuple(r[c] for c in COLUMNS) for r in trie.trie(spark.createDataFrame(rows, schema)).collect()]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = ["yes", "no  way", "", None, "a b\tc\n", "Üb er\x1cx"]
    rows = []
    for c in rnd.sample(range(-45, 140), 110):  # some bases are absent, some ids negative
        for t in range(rnd.choice([1, 1, 2, 3, 4, 5, 9])):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", None]), rnd.choice(texts if rnd.random() < 0.4 else ["same"])))
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0]]
    got = trie_rows(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_copies_and_of_long_conversations(spark, monkeypatch):
    """Many copies of one conversation, far more than a range of ids; a conversation of many turns beside short ones."""
    monkeypatch.setattr(trie, "IDS", 16)
    monkeypatch.setattr(trie, "HEAVY", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 600, 3) for t in range(3)]
    rows += [(1, t, "user", f"turn {t}") for t in range(60)] + [(21, t, "user", f"turn {t}" if t < 50 else "other words here") for t in range(60)]
    got = trie_rows(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string, key string, family string, place string, depth string"
    extra = ("x",) * 4
    assert trie_rows(spark, [], schema) == [] == trie_rows(spark, [(None, 1, "user", "x", *extra)], schema)
    long = "long words " * 50_000
    rows = [(7, 1, None, long, *extra), (8, None, "user", None, *extra), (8, None, "user", None, *extra)]
    assert set(trie_rows(spark, rows, schema)) == brute_trie([r[:4] for r in rows])


# divergence


def exact_rate(n, total):
    return 1 + 1_000_000_000 * (n + 2) // total


def brute_divergence(docs, least, top):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in docs:
        g = (lang or "", source or "")
        groups.add(g)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[g].update(found)
        df[g[0]].update(set(found))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, rows = {}, []
    for g in groups:
        terms = kept.get(g[0], [])
        total = sum(counts[g][t] for t in terms) + 2 * len(terms)
        p[g] = {t: exact_rate(counts[g][t], total) for t in terms}
    for lang, source in groups:
        terms = kept.get(lang, [])
        every = Counter()
        for g in groups:
            if g[0] == lang:
                every.update(counts[g])
        total = sum(every[t] for t in terms) + 2 * len(terms)
        mine = p[lang, source]
        pair = [(o, sum(f(mine[t], p[lang, o][t]) for t in terms)) for x, o in groups if x == lang and o != source]
        q = {t: exact_rate(every[t], total) for t in terms}
        term = [(t, f(mine[t], q[t])) for t in terms if counts[lang, source][t] and mine[t] > q[t]]
        for part, items, last in (("pair", pair, None), ("term", term, top)):
            rows += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last])]
    return sorted(rows)


def divergence_rows(spark, docs, schema="text string, lang string, source string", **more):
    got = divergence.audit(spark.createDataFrame(docs, schema), **more).collect()
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in got)


@pytest.mark.parametrize("terms,sources", [(1024, 512), (4, 2)])
def test_divergence_equals_brute_force(spark, monkeypatch, terms, sources):
    """Whole, and cut into many tiles and blocks of sources."""
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rnd = random.Random(5)
    vocab = ["the", "The", "Über", "über", "don't", "x1y", "naïve", "日本", "Ж"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = []
    for _ in range(220):
        lang, source = rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", "Ä", None, "hot", "hot"])
        own = vocab if source != "hot" else vocab[:12]
        docs.append((None if rnd.random() < 0.05 else " ".join(rnd.choice(own) for _ in range(rnd.randrange(0, 30))), lang, source))
    docs += [("rare words only", "fr", "a"), ("other", "fr", "b"), (None, "it", "alone"), docs[0], docs[0]]
    assert divergence_rows(spark, docs, least=6, top=4) == brute_divergence(docs, 6, 4)


def test_pair_sums_of_large_counts():
    """Counts that 64 bits can't multiply by the scale; heavy and light terms; only pairs of the asked blocks."""
    rnd = random.Random(2)
    names = [f"s{i}" for i in range(9)]
    lists = [[{"source": s, "n": rnd.choice([1, 2, 10**12, 7 * 10**11 + rnd.randrange(9)])} for s in rnd.sample(names, rnd.randrange(1, 10))] for _ in range(60)]
    totals = np.array([sum(e["n"] for t in lists for e in t if e["source"] == s) for s in names]) + 2 * len(lists)
    block = np.array([0] * 4 + [1] * 5)
    at = pa.array(lists, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p = [[exact_rate(next((e["n"] for e in t if e["source"] == s), 0), int(x)) for t in lists] for s, x in zip(names, totals, strict=True)]
    for left, right in ((0, 0), (0, 1), (1, 1)):
        got = {(int(a), int(b)): int(v) for a, b, v in zip(*divergence.pair_sums(at, names, totals, block, left, right), strict=True)}
        assert got == {(a, b): sum(map(f, p[a], p[b])) for a in range(9) for b in range(a + 1, 9) if (block[a], block[b]) == (left, right)}


def test_divergence_edges(spark):
    schema = "text string, lang string, source string, term string, n string, at string, value string, place string, total string, tile string"
    extra = ("x",) * 7
    assert divergence_rows(spark, [], schema) == []
    long = "Long words run on " * 40_000
    docs = [(long, "en", "s"), ("words", "en", "t"), (None, "en", "u"), ("1 2 3 \x00", None, None), ("", None, "v")]
    assert divergence_rows(spark, [(*d, *extra) for d in docs], schema, least=1) == brute_divergence(docs, 1, 10)


# pairwise ranking


def test_ranking_held_out(spark):
    """Rows that no label was learnt from: nearly all are on the right side, and order agrees with the labels."""
    got = {r.doc_id: r for r in pairwise.op13(spark, f"{DATA}/sf0.1").collect()}
    labels = [r for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect() if r.quality is not None and got[r.doc_id].held_out]
    assert len(labels) > 500 and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) > 0.99 * len(labels)
    good, bad = ([got[r.doc_id].score for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.995
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = pairwise.fit_tables(docs, labels), pairwise.fit_tables(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_bradley_terry():
    """The gradient is zero at the weights by finite differences; strengths of a planted model come back."""
    rng = np.random.default_rng(3)
    strength = np.array([1.5, 0.5, 0.0, -0.7, -1.3])
    x = np.eye(5)
    i, j = rng.integers(0, 5, 40_000), rng.integers(0, 5, 40_000)
    i, j = i[i != j], j[i != j]
    won = rng.random(len(i)) < 1 / (1 + np.exp(strength[j] - strength[i]))
    better, worse = np.where(won, i, j), np.where(won, j, i)
    w = pairwise.bradley_terry(x, better, worse, ridge=1e-6)
    assert np.abs((w - w.mean()) - (strength - strength.mean())).max() < 0.1
    loss = lambda v: np.logaddexp(0, -(x[better] - x[worse]) @ v).mean() + 5e-7 * v @ v
    for k in range(5):
        assert abs(loss(w + 1e-4 * x[k]) - loss(w - 1e-4 * x[k])) / 2e-4 < 1e-5


def test_preferences_meet_every_row():
    y = np.array([1] * 30 + [0] * 7)
    better, worse = pairwise.preferences(y, partners=3)
    assert set(better) == set(range(30)) and set(worse) == set(range(30, 37)) and len(better) == 90
    assert set(np.bincount(better)[:30]) == {3} and max(np.bincount(worse)[30:]) - min(np.bincount(worse)[30:]) <= 1


def test_figures_by_definition():
    texts = ["One two two\nOne two two\n\nUP $$ 12, no.", "", None, "a", "Ünï çödé ÜBER", "x " * 5000]
    got = pairwise.figures(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        letters = sum(c.isalpha() and (c.isascii() or c.encode()[0] >= 0xC0) for c in t)
        pairs = list(zip(w, w[1:], strict=False))
        over = lambda a, b: a / max(b, 1)
        want = [
            np.log2(1 + len(w)), np.log(max(len(set(w)), 1)) / np.log(max(len(w), 2)) if len(w) > 1 else len(w), np.log(max(len(set(pairs)), 1)) / np.log(max(len(w) - 1, 2)) if len(w) > 2 else float(len(w) > 1),
            over(max(Counter(w).values(), default=0), len(w)), over(sum(a == b for a, b in pairs), len(w)), over(len(re.findall(r"[#*$%&|<>]", t)), len(w)), over(len(re.findall("[A-Z]", t)), letters),
            over(len(re.findall("[0-9]", t)), len("".join(w))), over(len(re.findall("[.,;:!?]", t)), len(w)), over(len("".join(w)), len(w)), over(len(lines) - len({*lines}), len(lines)), np.log2(1 + over(len(w), len(lines))),
        ]
        assert np.allclose(row, want), (t[:40], row - want)


def test_ranking_edges(spark):
    schema = "doc_id long, text string, lang string, good string, x string, score string, quality string"
    extra = ("en", "x", "x", "x", "x")
    docs = spark.createDataFrame([(1, None, *extra), (2, "", *extra), (None, "no id", *extra), (4, "same", *extra), (4, "same", *extra), (6, "long words " * 100_000, *extra)], schema)
    labels = spark.createDataFrame([(1, 0), (2, 0), (6, 1), (4, 1), (4, None), (None, 1)], "doc_id long, quality int")
    model = pairwise.fit_tables(docs, labels)
    got = pairwise.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert pairwise.score(docs.limit(0), model).count() == 0
    for given, want in ((labels.limit(0), 1.0), (labels.where("quality = 0"), 0.0), (labels.where("quality = 1"), 1.0)):
        assert {r.score for r in pairwise.score(docs, pairwise.fit_tables(docs, given)).collect()} == {want}
