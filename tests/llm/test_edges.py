"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns: each case has its result."""

from __future__ import annotations

import zlib

import pytest

from brindle.llm import html, idfile, langid, merkle, minhash, mixing, packing, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, part string, k string, key string, digest string, h string, score string, a string, __id string"
EXTRA = ("x",) * 9
LONG = "long words run on and on " * 20_000
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, LONG), (7, "Ünïcödé ΓΔ привет 日本 🎉 end"), (7, "same id other text"), (None, "no id at all"), (8, "tie tie tie"), (8, "tie tie tie"), (9, "$$$ ### ***"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else "en", None if i in (5, None) else "s", len(t or ""), *EXTRA, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>a" * 3000, "x"), (3, "u", "<p>a" * 3000, "x"), (None, "u", "<b>x</b>" * 40, "x"), (5, "u", "<b>x</b>" * 40, "x"), (6, "u\r\nv", "<script>never closed", "x")], "page_id long, url string, html string, digest string")


def ordered(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_quality(docs, none):
    v = quality.verdicts(docs)
    assert v.count() == len(TEXTS) and v.where("base_failed is null or kept is null").count() == 0
    got = {r.doc_id: r for r in v.collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[6].n_repeat_words == got[6].n_words == 120_000 and got[9].n_symbols == 9
    assert quality.verdicts(none).count() == 0
    c = quality.clean(docs)
    assert c.columns == docs.columns and c.count() == 0 and quality.clean(none).count() == 0


def test_langid(docs, none):
    labelled = docs.where("lang is not null")
    m = langid.fit(labelled)
    got = langid.identify(docs, m)
    assert got.count() == len(TEXTS)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[9].lang_pred == "und" and by[1].score == 0.0 and by[4].lang_pred == "en"
    assert langid.identify(none, m).count() == 0
    blank = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(docs, blank).collect()} == {"und"}


def test_mixing(docs, none):
    got = mixing.mix(docs)
    assert got.count() == len(TEXTS) and got.where("taken > 2 * size or taken is null").count() == 0
    assert ordered(got, "doc_id", "taken") == ordered(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mix(none).count() == 0
    m = mixing.mixed(docs)
    assert m.columns == docs.columns and mixing.mixed(none).count() == 0


def test_merkle(docs, none):
    got = merkle.fingerprints(docs)
    assert got.count() == len(TEXTS)
    same = {r.doc_id: r.fingerprint for r in got.collect()}
    assert same[1] == same[2] != same[3] and same[4] == same[5]
    assert got.where("near_edited not between 0 and 1 or near_next not between 0 and 1").count() == 0
    assert merkle.fingerprints(none).count() == 0
    one = merkle.fingerprints(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_minhash(docs, none):
    got = minhash.near_duplicates(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(TEXTS) and by[5].component_id == 4 and not by[5].kept
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.deduplicated(docs).columns == docs.columns
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=50)


def test_warc(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert warc.read(spark, str(tmp_path / "w")).count() == 7 and warc.quarantined(spark, str(tmp_path / "w")).count() == 0
    assert got[1].payload_bytes == got[2].payload_bytes == 0 and got[1].record_type == got[3].record_type == "response"
    assert got[None].record_type == "revisit" and got[None].refers_to == 5 and got[None].payload_bytes == 320
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_html(pages):
    by = {r.page_id: r for r in html.extracted(pages).collect()}
    assert by[1].text == by[2].text == by[6].text == "" and by[3].n_chars == len(by[3].text) == 3000 * 2 - 1
    assert html.extracted(pages.limit(0)).count() == 0


def test_idfile(spark, docs, none, tmp_path):
    idfile.write(docs, str(tmp_path / "i"))
    got = idfile.read(spark, str(tmp_path / "i"), with_ids=True).orderBy("start").collect()
    assert len(got) == len(TEXTS) and got[0].doc_id is None
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in got)
    idfile.write(none, str(tmp_path / "n"))
    assert idfile.read(spark, str(tmp_path / "n")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, with_ids=True).collect()
    lengths: dict[int, int] = {}
    for r in got:
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 and r.offset + r.length <= 2048
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    assert sum(r.length for r in got if r.doc_id == 1) == 1 and packing.pack(none).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, none, tmp_path, stage):
    """Each stage by itself: what it keeps and changes of nulls, empty texts, repeated rows and clashing columns; an empty table stays empty."""
    import corpus_pipeline as cp

    spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = cp.STAGES[stage][1]
    got = run(spark, docs, str(tmp_path))
    rows = got.collect()
    if stage < 4:
        assert got.columns == docs.columns
    if stage == 0:  # a score for every row
        assert len(rows) <= len(TEXTS) and {r.doc_id for r in rows} <= {i for i, _ in TEXTS}
    if stage == 1:  # all fail the base rules: short, or repeating
        assert rows == []
    if stage == 2:  # copies of 4 and 8 go, texts without words and without an id stay
        assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, 6, 7, 7, None, 8, 8, 9], key=str)
    if stage == 3:  # what has words is taken once or twice
        assert {r.text for r in rows} <= {t for _, t in TEXTS} and len(rows) >= 1
    if stage == 4:  # every row has its end id
        ends = [r for r in rows if r.start + r.length == r.doc_tokens]
        assert len(ends) == len(TEXTS)
    assert run(spark, none, str(tmp_path)).count() == 0


def test_no_shared_folder(spark, monkeypatch):
    """A cluster that names no shared folder is an error; one machine takes a temporary one."""
    from brindle.llm import common

    class Conf:
        def __init__(self, master):
            self.held = {"spark.master": master}

        def get(self, key, default=None):
            return self.held.get(key, default)

        def set(self, key, value):
            self.held[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session("spark://host:7077"))
    here = Session("local[4]")
    assert common.shared_dir(here) == here.conf.get("spark.checkpoint.dir")


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in (1, 4, 5, 6, 7)] + [(7, 0, "x"), (8, None, "x")], "doc_id long, toxic int, text string")
    m = toxicity.fit_tables(docs, labels)
    got = toxicity.score(docs, m)
    assert got.count() == len(TEXTS) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, m).count() == 0
    blank = toxicity.fit_tables(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, blank).collect()} == {0.0}
    kept = toxicity.clean(docs, blank)
    assert kept.count() == len(TEXTS) and kept.columns == docs.columns
