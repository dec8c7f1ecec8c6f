"""Divergence of sources: term rates of every source of a language against each other source and the language.

Terms are counted where the texts lie and summed by language, source and term; a language keeps the terms of at least
``DOCS`` of its documents, each with its posting list (source and count). Rates are exact integers.

The sum over all kept terms of a pair of sources is made from two parts. Heavy terms, in at least half of the sources of a
tile, become rows of a dense matrix of rates, and whole columns are compared. Light terms stay posting lists: where both
sources lack a term, its rate is each source's least, so all light terms first count as if both lacked them; those that one
source holds are corrected by rate, as many terms at once as share it; those that both hold are corrected pair by pair of
their postings. All parts are 64-bit integers, and their sum is exact.

A tile is at most about ``TERMS`` terms by two blocks of ``SOURCES`` sources, so a task's memory doesn't grow with terms or sources.

Defined results: null text, lang and source are empty texts; a group without terms has each kept term at count 0; a language
that keeps no term gives its pairs the value 0 and no term rows; a language of one source has no pairs; repeated rows are
documents of their own; an empty table gives an empty result; further columns are ignored. Counts over 9e13 a group aren't met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, materialize, table, words

#: Documents of a language that hold a term that it keeps; rates are of SCALE; ranks of terms that are told.
DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a tile; sources of a block.
TERMS, SOURCES = 1024, 512
#: Bytes of text that are counted at once.
TEXT = 8 << 20

#: ASCII letters, small; every other ASCII character is a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the texts' offsets into them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if data is None:
        return words(texts)
    small = pa.py_buffer(data.to_pybytes().translate(_LETTERS))
    return words(pa.LargeStringArray.from_buffers(len(texts), offsets, small, None, 0, texts.offset))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, a block of texts at a time."""
    schema = arrow_schema(COUNTS)
    for batch in chunks(batches, limit=TEXT):
        flat, offsets = terms(batch.column("text"))
        if not len(flat):
            continue
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many, rows = len(coded.dictionary), batch.num_rows
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        n = np.diff(offsets)
        # one sort by group, term and document
        key = np.sort((np.repeat(group, n) * many + code) * rows + np.repeat(np.arange(rows), n))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pair = key[new] // rows
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        docs, at = np.diff(np.append(first, len(new))), new[first]
        total = np.diff(np.append(at, len(key)))
        found, which = pair[first] // many, pair[first] % many
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(found // len(source.dictionary))).cast(pa.string()), source.dictionary.take(pa.array(found % len(source.dictionary))).cast(pa.string()), coded.dictionary.take(pa.array(which)).cast(pa.string()), pa.array(total), pa.array(docs)], schema=schema
        )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def postings(docs: DataFrame, least: int = DOCS) -> DataFrame:
    """The terms that a language keeps, each with its sources and counts."""
    counts = _texts(docs).mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("at")).where(F.col("docs") >= least).select("lang", "term", "at")


def rate(n: F.Column, total: F.Column) -> F.Column:
    """1 + floor(SCALE * n / total) without a product that 64 bits can't hold: long division, by 10^5 and then by 10^4."""
    div = lambda a: F.call_function("div", a, total)
    first, second = (n % total) * 100_000, ((n % total) * 100_000 % total) * 10_000
    return 1 + div(n) * SCALE + div(first) * 10_000 + div(second)


def rates(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``rate`` of arrays."""
    first, second = n % total * 100_000, n % total * 100_000 % total * 10_000
    return 1 + n // total * SCALE + first // total * 10_000 + second // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with its place among the language's sources, its count and the language's, kept terms, tiles and blocks of sources."""
    found = _texts(docs).select("lang", "source").distinct()
    sums = kept.select("lang", F.explode("at").alias("at")).groupBy("lang", F.col("at.source").alias("source")).agg(F.sum("at.n").alias("total"))
    terms_of = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    lang = Window.partitionBy("lang")
    filled = found.join(sums, ["lang", "source"], "left").join(terms_of, "lang", "left").na.fill(0, ["total", "terms"])
    placed = filled.select("*", (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.sum("total").over(lang).alias("lang_total"), F.count("*").over(lang).alias("sources"))
    return placed.select(
        "lang", "source", "total", "terms", "lang_total", F.call_function("div", F.col("place"), F.lit(SOURCES)).cast("int").alias("block"),
        F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int").alias("tiles"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("blocks"),
    )


def pair_sums(at: pa.Array, sources: list[str], totals: np.ndarray, block: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all terms of a tile (posting lists ``at``), the sum of ``apart`` for each pair of a source of block ``left`` and a later one of block ``right``; totals are counts plus twice the kept terms."""
    many, n_terms = len(sources), len(at)
    value = np.zeros((many, many), np.int64)
    pairs = (block[:, None] == left) & (block[None, :] == right) & np.triu(np.ones((many, many), bool), 1)
    a_all, b_all = np.nonzero(pairs)
    if not n_terms or not len(a_all):
        return a_all, b_all, value[a_all, b_all]
    entries = pc.list_flatten(at)
    term = np.repeat(np.arange(n_terms), pc.list_value_length(at).to_numpy())
    column = pc.index_in(entries.field("source"), pa.array(sources, pa.string()))
    own = column.is_valid().to_numpy(zero_copy_only=False)
    column = column.fill_null(0).to_numpy().astype(np.int64)[own]
    term, n = term[own], entries.field("n").to_numpy(zero_copy_only=False).astype(np.int64)[own]
    p, least = rates(n + 2, totals[column]), rates(np.full(many, 2), totals)
    held = np.bincount(term, minlength=n_terms)
    heavy = 2 * held >= many
    rows_a = np.unique(a_all)
    # heavy terms: whole columns of a dense matrix
    row = np.cumsum(heavy) - 1
    tile = np.repeat(least[None, :], int(heavy.sum()), axis=0)
    dense = heavy[term]
    tile[row[term[dense]], column[dense]] = p[dense]
    for a in rows_a:
        b = np.flatnonzero(pairs[a])
        value[a, b] += apart(tile[:, a : a + 1], tile[:, b]).sum(axis=0)
    # light terms: as if both sources lacked them
    absent = apart(least[:, None], least[None, :])
    value += int((~heavy).sum()) * absent
    term, column, p = term[~dense], column[~dense], p[~dense]
    # what one source holds, by its rate
    order = np.lexsort((p, column))
    c, r = column[order], p[order]
    first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1]))) if len(c) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(c)))
    c, r = c[first], r[first]
    for a in np.unique(c):
        mine = c == a
        more = (times[mine][:, None] * (apart(r[mine][:, None], least[None, :]) - absent[a])).sum(axis=0)
        value[a] += more
        value[:, a] += more
    # what both hold, pair by pair of a posting list
    order = np.lexsort((column, term))
    term, column, p = term[order], column[order], p[order]
    for step in range(1, int(held[~heavy].max(initial=0))):
        i = np.flatnonzero(term[step:] == term[:-step])
        a, b, x, y = column[i], column[i + step], p[i], p[i + step]
        np.add.at(value, (a, b), apart(x, y) - apart(x, least[b]) - apart(least[a], y) + absent[a, b])
    return a_all, b_all, value[a_all, b_all]


PAIRS = "lang string, a string, b string, value long"


def _tile(postings: pa.Table, sources: pa.Table) -> pa.Table:
    schema = arrow_schema(PAIRS)
    if not sources.num_rows:
        return schema.empty_table()
    key = {c: sources.column(c)[0].as_py() for c in ("lang", "left", "right")}
    sources = sources.sort_by("source")
    names = sources.column("source").to_pylist()
    totals = sources.column("total").to_numpy() + 2 * sources.column("terms").to_numpy()
    at = postings.column("at").combine_chunks() if postings.num_rows else pa.array([], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    a, b, value = pair_sums(at, names, totals, sources.column("block").to_numpy(), key["left"], key["right"])
    names = pa.array(names, pa.string())
    return pa.Table.from_arrays([pa.array([key["lang"]] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], schema=schema)


def _in_tiles(rows: DataFrame, tile: F.Column, own: F.Column) -> DataFrame:
    """Rows in their tile or tiles, for each pair of blocks of sources that ``own`` lets."""
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    out = rows.withColumn("tile", tile).withColumn("left", F.explode(blocks)).withColumn("right", F.explode(blocks))
    return out.where((F.col("left") <= F.col("right")) & own)


def pair_divergence(kept: DataFrame, found: DataFrame) -> DataFrame:
    """lang, a, b (a before b) and the sum over all kept terms, tile by tile."""
    langs = found.groupBy("lang").agg(F.first("tiles").alias("tiles"), F.first("blocks").alias("blocks"))
    terms_in = _in_tiles(kept.join(langs, "lang"), F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"), F.lit(True)).select("lang", "tile", "left", "right", "at")
    sources_in = _in_tiles(found, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), F.col("block").isin(F.col("left"), F.col("right"))).select("lang", "tile", "left", "right", "source", "total", "terms", "block")
    key = ["lang", "tile", "left", "right"]
    sums = terms_in.groupBy(*key).cogroup(sources_in.groupBy(*key)).applyInArrow(_tile, PAIRS)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = DOCS, top: int = TOP) -> DataFrame:
    """For each (lang, source): its divergence from every other source of the language, and its ``top`` terms over the language's rate."""
    kept = materialize(postings(docs, least), "divergence-postings")
    found = materialize(groups(docs, kept), "divergence-groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_divergence(kept, found)
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pair_rows = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by_value))
    held = kept.select("lang", F.col("term").alias("item"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x.n).alias("lang_n"), F.explode("at").alias("at")).select("lang", "item", "lang_n", "at.source", "at.n")
    p, q = F.col("p"), F.col("q")
    rated = held.join(found, ["lang", "source"]).select("lang", "source", "item", rate(F.col("n") + 2, F.col("total") + 2 * F.col("terms")).alias("p"), rate(F.col("lang_n") + 2, F.col("lang_total") + 2 * F.col("terms")).alias("q"))
    over = rated.where(p > q).select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    term_rows = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pair_rows.unionByName(term_rows)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= {DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY 1),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM cells GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + ({SCALE} * (c.n + 2)) // (t.total + 2 * s.v) AS p FROM cells c JOIN totals t USING (lang, source) JOIN sizes s USING (lang)),
q AS (SELECT k.lang, k.term, 1 + ({SCALE} * (k.n + 2)) // (s.total + 2 * s.v) AS p FROM kept k JOIN sizes s USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
over_q AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.p) * (p.p - q.p) // (p.p + q.p) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM over_q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM all_pairs
UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM ranked WHERE rank <= {TOP}
"""
