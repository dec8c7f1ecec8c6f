"""Methods against brute force, exact round trips, planted cases and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import html, idfile, langid, merkle, minhash, mixing, packing, quality, rangecoder, toxicity, warc
from brindle.llm.components import connected
from brindle.llm.queries import ORACLE_SQL, QUERIES
from brindle.llm.tokens import Encoder, default_path
from tests.compare import assert_same
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_queries_by_number():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# HTML


def test_article_without_the_rest():
    page = """<html><body class="has-sidebar"><header>Top</header><nav><a href=a>Menu</a></nav><div id="cookie-notice">We use cookies</div>
    <div class="main"><article><header><h1>A &amp; B</h1></header><p>First  &eacute; <b>bold</b>
    line<br>goes on.<p>Second.<div class="ad-box">Buy</div><ul><li>one<li>two</ul><form><input value=x>Sign up</form><table><tr><td>c1<td>c2</table></article>
    <section id="comments"><p>Nice post, reader says a lot of things here that go on and on.</section></div>
    <aside>Side</aside><footer>Foot</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert html.extract(page) == "A & B\nFirst é bold line goes on.\nSecond.\none\ntwo\nc1\nc2"


def test_densest_subtree_without_article():
    links = "".join(f"<li><a href=/{i}>Link number {i} to elsewhere</a></li>" for i in range(30))
    body = "".join(f"<p>{'Plain sentence of the main text with many words. ' * 4}</p>" for _ in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><a href=x>Imprint</a></div></body>"
    text = html.extract(page)
    assert text.count("\n") == 5 and "Link number" not in text and "Imprint" not in text


def test_sections_headings_and_leads_without_article():
    texts = lambda name, n: [f"{name} sentence {i} of the main text has a good many words. " * 4 for i in range(n)]
    paragraphs = lambda found: "".join(f"<p>{t}</p>" for t in found)
    line = lambda found: [" ".join(t.split()) for t in found]
    one, two = texts("One", 6), texts("Two", 6)
    sections = f"<div><h2>One</h2><div>{paragraphs(one)}</div></div><div><h2>Two</h2><div>{paragraphs(two)}</div></div>"
    want = ["One", *line(one), "Two", *line(two)]
    assert html.extract(f"<body>{sections}</body>").split("\n") == want
    # wrappers that add nothing, sections of other sizes, a heading and a lead above all
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Link {i} to elsewhere</a></li>" for i in range(9)) + "</ul></div>"
    short = texts("Three", 1)
    third = f"<div><h2>Three</h2><div>{paragraphs(short)}</div></div>"
    page = f"<body><div>{menu}<div><h1>Title</h1><p>A short lead.</p><div><div>{sections}{third}</div></div></div></div><a href=/>Home</a> | <a href=/x>About us</a><div><a href=x>Imprint</a></div></body>"
    assert html.extract(page).split("\n") == ["Title", "A short lead.", *want, "Three", *line(short)]


def test_density_decides_not_the_tag(spark):
    """Pages give the same text when their article is a div, or stands in a block whose class sounds like a widget."""
    pages = [r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect() if r.html]
    for page in pages:
        want = html.extract(page)
        assert html.extract(re.sub(r"(?i)(</?)(article|main)\b", r"\1div", page)) == want
        assert html.extract(re.sub(r"(?is)<(article)\b.*</article>", lambda m: f"<div class='related widget'>{m[0]}</div>", page)) == want
    teaser = "<main><p>Teaser.</p></main>"
    body = "".join(f"<p>{'Plain sentence of the main text with many words. ' * 4}</p>" for _ in range(6))
    assert html.extract(f"<body><div>{body}</div>{teaser}</body>").count("\n") == 6


def by_definition(page):
    """Density sum of every element, straight from the definition: characters, links and tags counted anew under each."""
    dom = html.Dom(page)
    texts = ["" if t is None else " ".join(t.split()) for _, t in dom.parts]
    out = dom.cut(texts)
    chain = lambda i: [i] if i == 0 else [i, *chain(dom.parent[i])]
    under = [[j for j in range(len(dom.tag)) if i in chain(j) and not out[j]] for i in range(len(dom.tag))]
    counts = []
    for i, nodes in enumerate(under):
        held = [(j, len(t)) for (j, _), t in zip(dom.parts, texts, strict=True) if j in nodes]
        linked = sum(k for j, k in held if any(dom.tag[x] == "a" for x in chain(j)))
        counts.append((sum(k for _, k in held), linked, len([j for j in nodes if j != i]), sum(dom.tag[j] == "a" for j in nodes if j != i)))
    c_body, l_body = next((counts[i][:2] for i in range(len(dom.tag)) if dom.tag[i] == "body"), counts[0][:2])
    density = []
    for c, lc, t, lt in counts:
        t1, lt1, lc1 = max(t, 1), max(lt, 1), max(lc, 1)
        base = np.log(c / max(c - lc, 1) * lc + l_body / max(c_body, 1) * c + np.e)
        scale = np.log(base) if base > 1 + 1e-9 else 1.0  # no links on the page
        density.append(c / t1 * np.log(max(c / lc1 * t1 / lt1, 1.0)) / scale if c else 0.0)
    total = [sum(density[j] for j in range(1, len(dom.tag)) if dom.parent[j] == i) for i in range(len(dom.tag))]
    return dom, out, texts, density, total


def test_densities_by_definition():
    rnd = random.Random(8)
    for _ in range(25):
        parts = []
        for _ in range(rnd.randrange(5, 40)):
            tag = rnd.choice(["div", "p", "a", "b", "ul", "li", "span", "h2", "nav", "section"])
            parts.append(rnd.choice([f"<{tag}>", f"</{tag}>", "word " * rnd.randrange(1, 30), f"<{tag}>text</{tag}>"]))
        dom, out, texts, density, total = by_definition(f"<body>{''.join(parts)}</body>")
        got = html.densities(dom, out, texts)
        assert np.allclose(got[0], density) and np.allclose(got[1], total)


@pytest.mark.parametrize("part", ["<div>", "<p><button><div>", "<b>", "<li><div>", "<a '>", "</div></p>"])
def test_deep_pages_take_linear_time(part):
    def seconds(n):
        start = time.process_time()
        html.extract(f"<body><h1>T</h1>{part * n}text")
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.01)


def test_script_and_comment_never_closed():
    assert html.extract("<p>a</p><script>if (x < y) {") == "a"
    assert html.extract("<p>a</p><!-- b") == "a"
    assert html.extract("1 < 2 & 3 &lt; 4") == "1 < 2 & 3 < 4"


# quality


def test_limit_is_alike_in_a_large_host(spark):
    """A line of 20 documents goes from a host of 50 and from one of 6,000."""
    rows = [(h * 10_000 + i, " ".join(f"w{h}x{i}y{k}" for k in range(60)) + "\nnotice of all" * (i < 20), str(h)) for h, n in ((1, 50), (2, 6000)) for i in range(n)]
    v = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("removed_words > 0").select("source").collect()
    assert sorted(r.source for r in v) == ["1"] * 20 + ["2"] * 20


def test_frequent_lines_go_and_depleted_documents(spark):
    body = lambda i: "\n".join(f"unique {i} line {j} " + " ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6))
    rows = [(i, body(i) + "\nSubscribe  NOW!\nlast", "h") for i in range(40)]
    rows += [(100 + i, "\n".join(["Subscribe now! " + "a b c d e f g h"] * 9) + f"\nonly {i}", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    v = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert all(v[i].kept and v[i].removed_words == 3 for i in range(40))
    assert not any(v[100 + i].kept for i in range(30))
    kept = quality.clean(docs).collect()
    assert len(kept) == 40 and all("Subscribe" not in r.text and r.text.startswith("unique") for r in kept)


def test_long_lines_go_too(spark):
    notice = "This notice of the licence " + " ".join(f"clause{k}" for k in range(60))
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(40)) for j in range(3))
    rows = [(i, body(i) + "\n" + notice, "h") for i in range(20)] + [(100 + i, notice + f"\nonly {i}", "h") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    v = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert all(v[i].kept and v[i].removed_words == 65 for i in range(20)) and not any(v[100 + i].kept for i in range(5))
    assert {r.doc_id: r.text for r in quality.clean(docs).collect()} == {i: body(i) for i in range(20)}


# language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(0, 6, 4)
        offsets = np.append(0, np.cumsum(sizes))
        s = rng.normal(0, 5, (int(sizes.sum()), 3)).astype(np.float32)
        got = langid.viterbi(s, offsets, 4.0)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            cost = lambda p: sum(s[a + i, x] for i, x in enumerate(p)) - 4.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            best = max(product(range(3), repeat=int(b - a)), key=cost)
            assert abs(cost(best) - cost(got[a:b].tolist())) < 1e-3


def test_spans_of_mixed_text(spark):
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog went with the others to that house", "en"), ("der Hund und die Katze gehen nicht mit den anderen in das Haus", "de"), ("кошка и собака пошли домой", "ru")] * 5)], "doc_id long, text string, lang string")
    m = langid.fit(train)
    r = langid.identify(spark.createDataFrame([(1, "the dog and the cat with that house кошка и собака der Hund und die Katze gehen nicht")], "doc_id long, text string"), m).first()
    assert r.span_langs == ["en", "ru", "de"] and r.span_starts == [0, 8, 11]


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = QUERIES["op3_langid"](spark, f"{DATA}/sf0.01").where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_letters_are_what_unicode_calls_letters(spark):
    unlettered = ["🎉🎉 👍", "٣٤ १२ １２ 12", "، ؟ — …", "\u0301 \u20ac"]
    lettered = ["ⵣⵣⵣ", "ܐܒ", "ދިވެހި", "ℵ", "Ａｂ", "ﬁ", "ª"]
    m = langid.fit(spark.createDataFrame([(1, "the cat", "en"), (2, "кошка", "ru")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(unlettered + lettered)), "doc_id long, text string"), m).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in range(len(unlettered)))
    assert all(got[i].lang_pred in ("en", "ru") and got[i].score > 0 for i in range(len(unlettered), len(got)))


def test_no_odds_outweigh_the_script():
    """A language that doesn't use a word's script is no candidate, whatever its trigrams say."""
    odds = np.zeros((langid.BUCKETS + 1, 2), np.float32)
    odds[:-1, 1] = 1.0
    uses = np.zeros((langid.N_SCRIPTS, 2), bool)
    uses[1, 0] = uses[3, 1] = True  # Latin, Cyrillic
    scored, n = langid.Model(["la", "cy"], odds, uses).scores(pa.array(["a" * 40, "ы" * 40, "日本"]))
    assert scored[0, 1] == -np.inf and scored[1, 0] == -np.inf and np.isfinite(scored[2]).all()
    assert langid.viterbi(scored, np.array([0, 3])).tolist() == [0, 1, 1] and n.tolist() == [40, 40, 2]


# mixing


def test_targets_reshare_the_excess():
    t = mixing.targets({"a": 100, "b": 100, "c": 100, None: 100})
    # shares 600 * 5, 2, 1, 5 of 13: the first and the last are held at 200, 200 are left for 2 to 1
    assert t == {"a": 200.0, "b": pytest.approx(400 / 3), "c": pytest.approx(200 / 3), None: 200.0}


def test_sizes_and_targets_by_sql(spark, duck):
    """size, source_size and target of op4, and that every source's words come near its target."""
    got = QUERIES["op4_mixing"](spark, SF).toPandas()
    sizes = duck.execute(r"SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents").df()
    of = sizes.groupby("source")["size"].sum().to_dict()
    want = mixing.targets(of)
    both = got.merge(sizes, on="doc_id")
    assert len(both) == len(sizes) and (both.size_x == both.size_y).all()
    assert all(r.source_size == of[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken in (0, r.size_x, 2 * r.size_x) for r in both.itertuples())


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 2000):
        p, size = np.full(n, 0.37), rng.integers(0, 500, n)
        q = mixing.flight(p, size, rng.random(n))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
        done = mixing.landing(q, size)
        assert set(np.unique(done)) <= {0.0, 1.0}


def test_taken_words_come_near(spark):
    got = QUERIES["op4_mixing"](spark, f"{DATA}/sf0.01").toPandas()
    for _, g in got.groupby("target"):
        assert abs(g["taken"].sum() - g["target"].iloc[0] * len(g.groupby("source_size"))) < 0.02 * g["target"].iloc[0] * len(g.groupby("source_size")) + 5


# fingerprints


def test_edits_are_located():
    text = "\n".join(f"paragraph {i} has some words of its own {i * 7919 % 97}" for i in range(40))
    lines = text.split("\n")
    lines[17] = "another paragraph stands here"
    a, b = merkle.fingerprint(text), merkle.fingerprint("\n".join(lines))
    found = merkle.differences(a, b)
    flat = [(i, j) for i, s in enumerate(b.partition("|")[2].split(";")) for j, _ in enumerate(s.split("/")[1:])]
    assert [flat.index(x) for x in found] == [17] and merkle.differences(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1.0 and merkle.likeness(a, merkle.fingerprint("zzz")) == 0.0


def test_next_document_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in merkle.fingerprints(docs).collect()}
    assert len(got) == len(want)
    for (i, t), (_, nxt) in zip(want, want[1:] + want[:1], strict=True):
        e = merkle.edited(t, nxt)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].edited_fingerprint == merkle.fingerprint(e) and got[i].near_next == merkle.likeness(merkle.fingerprint(t), merkle.fingerprint(nxt))


# near duplicates


def brute(texts: dict[int, str], width: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_any_four_values_hold_a_pair_and_a_triple(spark):
    """Two sets that share four values of long lists meet in a pair of them, and in a triple of them."""
    drawn = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, (2000, 4))
    hot = [(i, sorted(map(int, row))) for i, row in enumerate(np.concatenate([drawn, [[-6, -3, 0, 3], [-5, -4, 1, 2], [0, 1, 2, 3]]]))]
    pairs = spark.createDataFrame(hot, "i long, hot array<long>").select("i", "hot", F.explode(F.expr(minhash.PAIRS)).alias("p")).select("i", "hot", "p.x", "p.y")
    assert pairs.select("i").distinct().count() == len(hot)
    triples = pairs.select("i", "x", "y", F.explode(F.expr(minhash.THIRDS)).alias("z"))
    assert triples.select("i").distinct().count() == len(hot)
    assert triples.count() == triples.select("i", F.array_sort(F.array("x", "y", "z"))).distinct().count()


@pytest.mark.parametrize("lists", [minhash.LISTS, (2, 3, 4)])
def test_components_by_brute_force(spark, monkeypatch, lists):
    """Short lists send a large group of near copies through every level, ties and blocks."""
    monkeypatch.setattr(minhash, "LISTS", lists)
    monkeypatch.setattr(minhash, "CLUSTER", 30)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        if i < 80:
            t = list(base)
            for _ in range(rng.randrange(14)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(9999)}"
        else:
            t = [f"w{min(int(rng.expovariate(0.05)), 399)}" for _ in range(rng.randrange(1, 80))]
        texts[i] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == brute(texts, 2, 80)


def test_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for width in (2, 5):
        want = brute({r.doc_id: r.text for r in docs.collect()}, width, 80)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, width).collect()} == want


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    assert {r.node: r.label for r in connected(links).collect()} == {**{i: 0 for i in range(31)}, 50: 50, 60: 50}


# WARC


def test_salvage_skips_what_is_damaged():
    rnd = random.Random(1)
    records = [warc.make_record(i, f"http://x/{i}", rnd.randbytes(300 + i)) for i in range(30)]
    members = [warc._member(r) for r in records]
    at = np.cumsum([0, *map(len, members)]).tolist()
    data = bytearray(b"".join(members))
    data[at[10] + 40] ^= 255
    data[at[20] : at[20]] = b"junk\x1f\x8b\x08junk"
    got, gaps = warc.salvage(bytes(data))
    assert len(got) == 29 and [g[:2] for g in gaps] == [(at[10], at[11]), (at[20], at[20] + 11)]
    plain = bytearray(b"".join(records))
    plain[len(records[0]) + len(records[1]) - 10] ^= 1
    got, gaps = warc.salvage(bytes(plain[:-3]))
    assert len(got) == 28 and [g[2] for g in gaps] == ["block digest", "truncated"]
    assert warc.salvage(b"") == ([], [])


def test_salvage_inside_a_member():
    records = [warc.make_record(i, f"http://x/{i}", b"payload %d " % i * 50) for i in range(5)]
    bad = bytearray(b"".join(records))
    bad[len(records[0]) + len(records[1]) - 30] ^= 1  # the second record's block
    data = warc._member(bytes(bad)) + warc._member(records[0])
    got, gaps = warc.salvage(data)
    assert [h["x-page-id"] for _, h, _ in got] == ["0", "2", "3", "4", "0"] and [g[2] for g in gaps] == ["block digest, 4 records kept"]
    # a member that breaks off keeps what it inflated to
    rnd = random.Random(4)
    long = [warc.make_record(i, "u", rnd.randbytes(3000)) for i in range(4)]
    whole = warc._member(b"".join(long))
    got, gaps = warc.salvage(whole[: len(whole) // 2] + warc._member(records[1]))
    assert [h["x-page-id"] for _, h, _ in got] == ["0", "1"] and len(gaps) == 1 and gaps[0][2].endswith("1 records kept")


def test_headers_of_any_length(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/" + "u" * 70_000, "<p>a"), (2, "http://y/" + "v" * 3_000_000, None)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert {r.page_id: len(r.url) for r in warc.read(spark, str(tmp_path / "w")).collect()} == {1: 70_009, 2: 3_000_009}
    assert warc.quarantined(spark, str(tmp_path / "w")).count() == 0


# ids


def test_files_follow_by_number():
    names = [f"file:/x/part-{i:05d}-ab-c-1-c{k:03d}.txt" for i in range(99_990, 100_011) for k in (0, 1)] + ["file:/x/part-00002-ab-c-1-c1000.txt"]
    shuffled = random.Random(1).sample(names, len(names))
    assert sorted(shuffled, key=idfile.file_order) == [names[-1], *names[:-1]]


def test_files_by_the_tokenizer(spark, tmp_path, monkeypatch):
    """start, n_tokens and ids_crc32 of the query against the tokenizer itself; a file a segment."""
    monkeypatch.setattr(idfile, "SEGMENT", 20_000)
    monkeypatch.setattr(idfile, "SEGMENTS", 1)
    tokenizer = Encoder(default_path()).tokenizer
    start = 0
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_idfile"](spark, SF).collect()} == want


def test_encoder_equals_the_tokenizer():
    e = Encoder(default_path())
    rnd = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "b", "é", "'s", "1", "!", "<|endoftext|>", " ", "　", "日", "🎉", "\x85", "word", "Word,"]
    texts = pa.array(["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(2000)] + [None, ""])
    ids, offsets = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    again, off = e.encode(texts, end=5)
    assert [again[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*w, 5] for w in want]


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 30_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.3, n) % 50257, np.full(n, 65535)):
        blocks = rangecoder.encode(ids.astype(np.uint32))
        assert np.array_equal(rangecoder.decode(blocks), ids)
        if n > 4096:
            bad = [*blocks[:1], (blocks[1][0], blocks[1][1] ^ 1, blocks[1][2]), *blocks[2:]]
            with pytest.raises(rangecoder.Corrupt):
                rangecoder.decode(bad)


def test_blocks_decode_alone():
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.full(4096, 7), rng.integers(0, 65536, 4096), rng.zipf(1.2, 4096) % 50257, rng.integers(0, 300, 5000)]).astype(np.uint32)
    blocks = rangecoder.encode(ids)
    for i in range(len(blocks)):
        assert np.array_equal(rangecoder.decode(blocks[i : i + 1]), ids[i * 4096 : i * 4096 + blocks[i][0]])
    assert np.array_equal(rangecoder.decode(blocks[::-1]), np.concatenate([ids[i * 4096 : (i + 1) * 4096] for i in range(len(blocks))][::-1]))


def test_coder_learns_repeats():
    ids = np.tile(np.random.default_rng(0).integers(0, 50257, 64), 256).astype(np.uint32)
    assert sum(len(b[2]) for b in rangecoder.encode(ids)) < len(ids) / 2


# packing


def quadratic(pieces, room=2048):
    """Mean and spread of the quadratic cost of the full sequences."""
    costs: dict[int, float] = {}
    used: dict[int, int] = {}
    for _, _, n, seq, _ in pieces:
        costs[seq] = costs.get(seq, 0.0) + packing.QUADRATIC * n * n
        used[seq] = used.get(seq, 0) + n
    full = np.array([c for s, c in costs.items() if used[s] > 0.9 * room])
    return full.mean(), full.std()


def concatenated(sizes, room=2048):
    ends = np.cumsum(sizes)
    found = []
    for text, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        while a < b:
            n = min(b - a, room - a % room)
            found.append((text, 0, n, a // room, a % room))
            a += n
    return found


@pytest.mark.parametrize("kind", ["lognormal", "documents"])
def test_every_id_is_placed_once_and_costs_are_even(spark, kind):
    """Mean and spread of the quadratic cost lie a quarter or more below those of texts laid end to end and cut."""
    rng = np.random.default_rng(2)
    if kind == "lognormal":
        sizes = np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 20_000)
    else:
        sizes = np.array([r.n for r in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").selectExpr("length(text) div 4 + 1 as n").collect()])
    pieces = packing.assign(sizes)
    fill: dict[int, int] = {}
    spans: dict[int, list] = {}
    for text, start, n, seq, offset in pieces:
        assert offset == fill.get(seq, 0) and n > 0
        spans.setdefault(text, []).append((start, n))
        fill[seq] = offset + n
    for text, size in enumerate(sizes.tolist()):
        at = 0
        for start, n in sorted(spans[text]):
            assert start == at
            at += n
        assert at == size
    assert all(n <= 2048 for n in fill.values()) and 2048 * len(fill) <= 1.012 * sizes.sum() + 2048  # little padding
    mean, spread = quadratic(pieces)
    plain_mean, plain_spread = quadratic(concatenated(sizes))
    assert mean < 0.85 * plain_mean and spread < 0.75 * plain_spread
    # the same pieces in the same order, each at random where there is room
    left, random_costs = np.full(len(fill), 2048), np.zeros(len(fill))
    for n in sorted((n for _, _, n, _, _ in pieces), reverse=True):
        open_ = np.flatnonzero(left >= n)
        i = rng.choice(open_) if len(open_) else int(left.argmax())
        left[i] -= n
        random_costs[i] += packing.QUADRATIC * n * n
    assert spread < 0.5 * random_costs.std()
    own = np.zeros(len(fill))
    np.add.at(own, [seq for _, _, _, seq, _ in pieces], [packing.QUADRATIC * n * n for _, _, n, _, _ in pieces])
    total = packing.LINEAR * 2048 + own
    assert total.max() < 1.1 * total.mean()
    # texts are cut into as few pieces as half a sequence allows, but for those that no room is left for
    parts = sum(len(v) for v in spans.values())
    assert parts < 1.35 * sum(-(-n // 1024) for n in sizes.tolist())


def test_each_piece_goes_to_the_cheapest_with_room():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 900, 60)
    room = 1024
    pieces = packing.assign(sizes, room)
    rooms = {i: room for i in range(int(sizes.sum()) // room)}
    spent = dict.fromkeys(rooms, 0.0)
    for text, _, n, seq, offset in pieces:
        if n == sizes[text]:  # whole: none cheaper had room
            open_ = [i for i in rooms if rooms[i] >= n]
            assert seq not in rooms and not open_ or spent[seq] <= min(spent[i] for i in open_)
        if seq in rooms:
            assert offset == room - rooms[seq]
            rooms[seq] -= n
            spent[seq] += packing.cost(n)


def test_pieces_by_the_tokenizer(spark):
    tokenizer = Encoder(default_path()).tokenizer
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    met = dict.fromkeys(want, 0)
    for r in QUERIES["op9_packing"](spark, SF).collect():
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        met[r.doc_id] += r.length
    assert met == {i: len(x) for i, x in want.items()}


# toxicity


def test_pair_of_terms_that_single_weights_miss():
    """Neither word alone tells the class, only both together."""
    rng = np.random.default_rng(0)
    x = (rng.random((600, 4)) < 0.5).astype(np.float32)
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(np.float32)
    m = toxicity.train(np.arange(4), x, y, epochs=600, rate=0.05)
    row, term = np.nonzero(x)
    got = m.scores(row, term, x[row, term], len(x)) >= 0.5
    assert (got == y).mean() > 0.95


def test_score_is_the_double_sum(spark):
    """Scores of whole texts against every pair of terms added up one by one."""
    texts = ["you silly goose go home", "", "goose goose goose and the home of a silly one", "zzz"]
    known = np.unique(np.concatenate([np.array(sorted({b for w in t.split() for b in toxicity.terms(w)} | {toxicity._bucket(f"len{len(t.split()).bit_length()}")}), np.int64) for t in texts[:3]]))
    rng = np.random.default_rng(3)
    m = toxicity.Machine(known, -0.3, rng.normal(0, 0.3, len(known)), rng.normal(0, 0.3, (len(known), toxicity.RANK)))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    place = {b: i for i, b in enumerate(known.tolist())}
    for i, t in enumerate(texts):
        counts: dict[int, int] = {}
        for b in [b for w in t.split() for b in toxicity.terms(w)] + [toxicity._bucket(f"len{len(t.split()).bit_length()}")]:
            if b in place:
                counts[place[b]] = counts.get(place[b], 0) + 1
        z = m.bias + sum(m.weights[a] * np.log2(1 + n) for a, n in counts.items())
        for a in counts:
            for b in counts:
                if a < b:
                    z += float(m.factors[a] @ m.factors[b]) * np.log2(1 + counts[a]) * np.log2(1 + counts[b])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_pair_beside_thousands_of_other_terms(spark):
    """Words that are as frequent in both classes, and count only together, stand beside 3,000 that tell nothing."""

    def drawn(first: int, rows: int, seed: int) -> list[tuple[int, str, int]]:
        rnd = random.Random(seed)
        found = []
        for i in range(rows):
            a, b = i % 2, i // 2 % 2
            w = [f"f{rnd.randrange(3000):03x}" for _ in range(12)] + ["qa"] * a + ["qb"] * b
            rnd.shuffle(w)
            found.append((first + i, " ".join(w), int(a == b)))
        return found

    m = toxicity.fit(spark.createDataFrame(drawn(0, 2000, 1), "doc_id long, text string, toxic int"))
    new = drawn(10_000, 400, 2)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string, toxic int"), m).collect()}
    assert sum(got[i] == y for i, _, y in new) > 380


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    got = QUERIES["op10_toxicity"](spark, f"{DATA}/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.9 * got.toxic.sum() and hit >= 0.95 * got.predicted.sum()


# pipeline


def test_stages_by_plain_rules(spark):
    import corpus_pipeline as cp

    docs, sf = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), f"{DATA}/sf0.01"
    columns = docs.columns
    machine = toxicity.fit_tables(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, machine).where("score >= 0.3").collect()}
    one = cp.STAGES[0][1](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - bad and one.columns == columns
    two = cp.STAGES[1][1](spark, one, sf).persist()
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in quality.verdicts(one).where("kept").collect()} and two.columns == columns
    three = cp.STAGES[2][1](spark, two, sf).persist()
    want = brute({r.doc_id: r.text for r in two.collect()}, 5, 80)
    assert {r.doc_id for r in three.collect()} == {i for i, c in want.items() if i == c} and three.columns == columns
    four = cp.STAGES[3][1](spark, three, sf).persist()
    times = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 2 and times == {r.doc_id: r.copies for r in mixing.mix(three, key=mixing.F.xxhash64(*columns)).where("copies > 0").collect()} and four.columns == columns
    five = cp.STAGES[4][1](spark, four, sf)
    assert five.select("doc_id").distinct().count() == len(times)
