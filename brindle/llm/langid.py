"""Language identification: script ranges narrow candidates, Viterbi over per-word scores labels spans.

The model holds, for each language of the labelled rows, log-odds of hashed byte trigrams (a word
with its edges marked) against the mean of all languages, and the scripts that make up at least 1 %
of its letters. A word's candidates are the languages that use its script, and no others (all of them for a
script that no language uses). Letters are what Unicode calls so. Scores of distinct words are computed once per block; a Viterbi pass over each
text's words, which pays ``SWITCH`` for each change of language, labels every word. The language
with most letters is the text's.

Defined results: null texts and texts without a letter are ``und`` with score 0.0 and no spans; so
is every text if no row is labelled; ties go to the language that sorts first; repeated rows have a
row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, bounded_sample, chunks, table, vocabulary, words

#: Most labelled rows that the model is fitted on; trigram buckets; costs in nats.
SAMPLE, BUCKETS, SWITCH = 12_000, 1 << 16, 8.0
#: First code points of the ranges that scripts are told apart by, with the scripts' numbers (fixed values of Unicode).
SCRIPT_STARTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x750, 0x780, 0x8A0, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2C80, 0x3040, 0x3100, 0x3130, 0x31A0, 0x31F0, 0x3400, 0xA000, 0xA640, 0xA6A0, 0xA720, 0xA800, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFB13, 0xFB1D, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0xFF66, 0xFFA0, 0xFFE0, 0x20000, 0x32000])
SCRIPTS = np.array([1, 2, 3, 4, 5, 6, 8, 6, 8, 6, 7, 8, 9, 8, 10, 11, 8, 1, 2, 8, 1, 8, 12, 8, 11, 8, 12, 13, 8, 3, 8, 1, 8, 11, 8, 13, 1, 4, 5, 6, 8, 6, 1, 12, 11, 8, 13, 8], np.uint8)
N_SCRIPTS = 14


@cache
def script_table() -> np.ndarray:
    """The script of every code point that Unicode calls a letter (general categories L), by range; 0 for all others."""
    points = np.arange(sys.maxunicode + 1)
    letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(letters, SCRIPTS[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1], 0).astype(np.uint8)


def _scripts(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the script of most of its letters (0: no letter), and its number of letters."""
    listed = vocab.to_pylist()
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    kinds = script_table()[np.frombuffer("".join(listed).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(listed)), sizes)
    letters = kinds > 0
    counts = np.bincount(owner[letters] * N_SCRIPTS + kinds[letters], minlength=len(listed) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
    n = counts.sum(1)
    return np.where(n > 0, counts.argmax(1), 0), n


def _trigrams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased words with edges, and each word's offset; ``BUCKETS`` where a window leaves its word."""
    lower = pc.utf8_lower(vocab)
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    b = np.empty(ends[-1], np.uint32)
    inner = np.ones(len(b), bool)
    inner[starts] = inner[ends - 1] = False
    b[starts], b[ends - 1] = 256, 257
    b[inner] = np.frombuffer("".join(lower.to_pylist()).encode(), np.uint8)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h = (h & np.uint32(BUCKETS - 1)).astype(np.int64)
    h[(b[:-2] == 257) | (b[1:-1] == 257)] = BUCKETS
    return h, starts


def _counted(langs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), N_SCRIPTS), np.int64)
        order = {x: i for i, x in enumerate(langs)}
        for batch in chunks(batches):
            flat, offsets = words(batch.column("text"))
            if not len(flat):
                continue
            code, vocab = vocabulary(flat)
            own = np.repeat(np.array([order[x] for x in batch.column("lang").to_pylist()]), np.diff(offsets))
            kind, n = _scripts(vocab)
            h, starts = _trigrams(vocab)
            sizes = np.diff(np.append(starts, len(h) + 2))
            word = np.repeat(np.arange(len(starts)), sizes)[: len(h)]
            for i in range(len(langs)):
                times = np.bincount(code[own == i], minlength=len(vocab))
                grams[i] += np.bincount(h, weights=times[word], minlength=BUCKETS + 1)[:BUCKETS].astype(np.int64)
                scripts[i] += np.bincount(kind, weights=times * n, minlength=N_SCRIPTS).astype(np.int64)
        both = np.concatenate([grams, scripts], axis=1)
        i, k = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(both[i, k])], schema=arrow_schema("lang int, gram int, n long"))

    return count


class Model:
    """Log-odds ``[BUCKETS + 1, languages]``, the last row zero, and script use ``[N_SCRIPTS, languages]``."""

    def __init__(self, langs: list[str], odds: np.ndarray, uses: np.ndarray):
        self.langs, self.odds, self.uses = langs, odds, uses

    def scores(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind, n = _scripts(vocab)
        h, starts = _trigrams(vocab)
        total = np.add.reduceat(self.odds[h], starts, axis=0)
        uses = self.uses[kind]
        total[~uses & uses.any(1)[:, None]] = -np.inf
        total[n == 0] = 0
        return total, n


def fit(labelled: DataFrame, bound: int = SAMPLE) -> Model:
    """Counts over at most ``bound`` rows with ``text`` and a non-null ``lang``, taken by hash of ``doc_id``."""
    rows = bounded_sample(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), "doc_id", bound)
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros((N_SCRIPTS, 0), bool))
    counts = rows.select("text", "lang").mapInArrow(_counted(langs), "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(langs), BUCKETS + N_SCRIPTS))
    both[counts["lang"], counts["gram"]] = counts["n"]
    grams, scripts = both[:, :BUCKETS].T, both[:, BUCKETS:].T.copy()
    share = (grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)
    odds = np.log(share)
    scripts[0] = 0
    uses = scripts > 0.01 * np.maximum(scripts.sum(0), 1)
    odds = np.append(odds - odds.mean(1, keepdims=True), np.zeros((1, len(langs))), axis=0)
    return Model(langs, odds.astype(np.float32), uses)


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word, all texts of a block in step: ``scores`` [words, labels], ``offsets`` by text."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = offsets[:-1][order], sizes[order]
    n, k = scores.shape
    label = np.zeros(n, np.int64)
    if not n:
        return label
    stay = np.ones((n, k), bool)
    best = np.zeros(n, np.int64)  # best label up to and with each word
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more words than t
    v = np.zeros((len(sizes), k), scores.dtype)
    for t, m in enumerate(active):
        at, w = first[:m] + t, v[:m]
        if t:
            cut = w.max(1, keepdims=True) - switch
            stay[at] = w >= cut
            np.maximum(w, cut, out=w)
        w += scores[at]
        best[at] = w.argmax(1)
    last = first + sizes - 1
    now = best[last[sizes > 0]]
    now = np.concatenate([now, np.zeros(len(sizes) - len(now), np.int64)])
    for back in range(sizes[0]):
        m = active[back]
        at = last[:m] - back
        label[at] = now[:m]
        held = stay[at, now[:m]]
        before = best[np.maximum(at - 1, 0)]
        now[:m] = np.where(held, now[:m], before)
    return label


OUT = "doc_id long, lang_pred string, score double, span_langs array<int>, span_starts array<int>"


def _labelled(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = arrow_schema(OUT)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = batch.num_rows
            flat, offsets = words(batch.column("text"))
            pred, score, starts, langs = np.full(rows, -1), np.zeros(rows), np.zeros(0, np.int32), np.zeros(0, np.int32)
            ends = np.zeros(rows + 1, np.int64)
            if len(flat) and model.langs:
                code, vocab = vocabulary(flat)
                scored, n = model.scores(vocab)
                got, letters = viterbi(scored[code], offsets), n[code]
                text = np.repeat(np.arange(rows), np.diff(offsets))
                by = np.bincount(text * len(model.langs) + got, weights=letters, minlength=rows * len(model.langs)).reshape(rows, -1)
                total = by.sum(1)
                pred = np.where(total > 0, by.argmax(1), -1)
                score = np.where(total > 0, by.max(1) / np.maximum(total, 1), 0.0)
                new = np.append(True, (got[1:] != got[:-1]) | (text[1:] != text[:-1])) & (total > 0)[text]
                at = np.flatnonzero(new)
                starts, langs = (at - offsets[text[at]]).astype(np.int32), got[at].astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=rows))])
            offs = pa.array(ends.astype(np.int32))
            names = pa.array(["und", *model.langs])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), names.take(pa.array(pred + 1)), pa.array(score), pa.ListArray.from_arrays(offs, pa.array(langs)).cast(schema.field("span_langs").type), pa.ListArray.from_arrays(offs, pa.array(starts)).cast(schema.field("span_starts").type)], schema=schema)

    return label


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in that language), spans: languages and first words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_labelled(model), OUT).withColumn(
        "span_langs", F.expr(f"transform(span_langs, i -> element_at(array({', '.join(repr(x) for x in model.langs) or 'string(null)'}), i + 1))")
    )


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
