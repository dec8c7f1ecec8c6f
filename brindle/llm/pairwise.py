"""Quality by pairwise ranking: a Bradley-Terry model of which of two documents is the better one.

A text becomes ``FEATURES`` figures (length, variety of words and word pairs, marks, symbols, capitals, digits, lines), each
spread over the quantiles of the sample as hat functions, so that a figure can be bad at both ends. Of the labelled rows
each good one is preferred to each bad one; every row of the sample enters ``PARTNERS`` such pairs, drawn by a seed. The
model learns one weight a hat by the logistic loss of the feature differences, so that a document's score is its own and
the difference of two scores is the log-odds that the one is preferred. The threshold is a quantile of the sample's scores:
as large a share falls under it as the labels call bad. ``score`` is the logistic function of a document's distance to it,
moved so that the threshold is ``THRESHOLD``.

Defined results: null and empty texts have no words and are scored by their figures (all 0); with no labelled row every
score is 1, with labels of one class only it is that class; a document with several labels counts as bad if one is; of rows
that share an id one is learnt from; null labels are no labels; repeated rows have a row each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, bounded_sample, chunks, table, words

#: Most labelled rows that the model is fitted on; pairs of a row; quantiles of a figure; weight of the penalty; steps of the fit.
SAMPLE, PARTNERS, KNOTS, RIDGE, STEPS = 12_000, 8, 8, 1e-3, 30
THRESHOLD = 0.3
#: Bytes of text that are measured at once.
TEXT = 4 << 20

FEATURES = ("words", "variety", "pair_variety", "most_frequent", "repeats", "symbols", "capitals", "digits", "marks", "word_length", "line_repeats", "line_words")

_kind = {name: np.array([chr(c) in chars for c in range(256)]) for name, chars in (("symbols", "#*$%&|<>"), ("marks", ".,;:!?"), ("digits", "0123456789"), ("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))}
_kind["letters"] = np.array([c >= 0xC0 or chr(c).isalpha() and c < 128 for c in range(256)])
_kind["chars"] = np.array([not 0x80 <= c < 0xC0 and c > 32 for c in range(256)])


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and how often the most frequent stands there."""
    key = np.sort(row * (int(code.max(initial=0)) + 1) + code)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    owner, most = key[first] // (int(code.max(initial=0)) + 1), np.zeros(rows, np.int64)
    np.maximum.at(most, owner, np.diff(np.append(first, len(key))))
    return np.bincount(owner, minlength=rows), most


def figures(texts: pa.Array) -> np.ndarray:
    """[texts, FEATURES] of whole texts (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    rows = len(texts)
    flat, offsets = words(texts)
    n = np.diff(offsets)
    row = np.repeat(np.arange(rows), n)
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, most = _distinct(row, code, rows)
    same = row[1:] == row[:-1]
    pair_codes = (code[:-1] * (int(code.max(initial=0)) + 1) + code[1:])[same]
    pair_row = row[1:][same]
    _, pair_codes = np.unique(pair_codes, return_inverse=True)
    pairs, _ = _distinct(pair_row, pair_codes.astype(np.int64), rows)
    repeats = np.bincount(pair_row, weights=(code[1:] == code[:-1])[same], minlength=rows)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    count = {k: np.diff(np.append(0, np.cumsum(of[data], dtype=np.int64))[bounds]) for k, of in _kind.items()}
    lines = pc.split_pattern(texts, "\n")
    line, starts = lines.flatten(), lines.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    held = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0).to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(rows), np.diff(starts))[held]
    n_lines = np.bincount(line_row, minlength=rows)
    line_kinds, _ = _distinct(line_row, line.filter(pa.array(held)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), rows)
    over = lambda a, b: a / np.maximum(b, 1)
    long = n > 1
    logs = np.log(np.maximum(n, 2))
    variety = np.where(long, np.log(np.maximum(kinds, 1)) / logs, n)
    pair_variety = np.where(n > 2, np.log(np.maximum(pairs, 1)) / np.log(np.maximum(n - 1, 2)), long)
    return np.column_stack([
        np.log2(1 + n), variety, pair_variety, over(most, n), over(repeats, n), over(count["symbols"], n), over(count["capitals"], count["letters"]), over(count["digits"], count["chars"]), over(count["marks"], n),
        over(count["chars"], n), over(n_lines - line_kinds, n_lines), np.log2(1 + over(n, n_lines)),
    ]).astype(float)


def knots(x: np.ndarray, many: int = KNOTS) -> list[np.ndarray]:
    """Distinct quantiles of each column of the sample, its ends included."""
    return [np.unique(np.quantile(col, np.linspace(0, 1, many))) for col in x.T]


def hats(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Each column as weights of the two knots beside it; beyond the ends, of the end."""
    out = []
    for col, k in zip(x.T, at, strict=True):
        h = np.zeros((len(col), len(k)))
        if len(k) == 1:
            h[:, 0] = 1
        else:
            col = np.clip(col, k[0], k[-1])
            j = np.clip(np.searchsorted(k, col, side="right") - 1, 0, len(k) - 2)
            t = (col - k[j]) / (k[j + 1] - k[j])
            i = np.arange(len(col))
            h[i, j], h[i, j + 1] = 1 - t, t
        out.append(h)
    return np.hstack(out) if out else np.zeros((len(x), 0))


def preferences(y: np.ndarray, partners: int = PARTNERS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Preferred and other row of each pair: every row of either class meets ``partners`` of the other class, all in turn before one comes again."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    many = partners * max(len(good), len(bad))
    dealt = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-many // len(rows)))])[:many]
    return dealt(good), dealt(bad)


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights w of the least mean logistic loss of w (x[better] - x[worse]) plus a penalty, by Newton steps that are halved until the loss falls."""
    d = x[better] - x[worse]
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + 0.5 * ridge * v @ v
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = ridge * w - d.T @ p / len(d)
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-10:
            break
        w, now = w - size * step, new
    return w


class Ranker:
    """Knots, a weight a hat, and the raw score of the threshold; without knots all texts have the score ``level``."""

    def __init__(self, at: list[np.ndarray], weights: np.ndarray, cut: float, level: float | None = None):
        self.at, self.weights, self.cut, self.level = at, weights, cut, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return hats(x, self.at) @ self.weights

    def scores(self, x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        if self.level is not None:
            return np.full(len(x), self.level)
        got = 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(threshold / (1 - threshold)), -30, 30)))
        return np.where(self.raw(x) >= self.cut, np.maximum(got, threshold), got)


def train(x: np.ndarray, y: np.ndarray) -> Ranker:
    if not len(y) or y.min() == y.max():
        return Ranker([], np.zeros(0), 0.0, float(y[0]) if len(y) else 1.0)
    at = knots(x)
    h = hats(x, at)
    w = bradley_terry(h, *preferences(y))
    raw = h @ w
    # between the scores of the last that falls under the threshold and the next
    bad = int((y != 1).sum())
    order = np.sort(raw)
    return Ranker(at, w, float((order[bad - 1] + order[bad]) / 2))


ROWS = "doc_id long, good int, x array<double>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(ROWS)
    for batch in chunks(batches, limit=TEXT):
        x = figures(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())).cast(schema.field(2).type)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("good").cast(pa.int32()), lists], schema=schema)


def fit(labelled: DataFrame) -> Ranker:
    """Fits on rows with ``doc_id``, ``text`` and ``quality``, a bounded sample; those of one id count once."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("quality").cast("int").alias("good")).where("good is not null")
    got = rows.mapInArrow(_rows, ROWS).groupBy("doc_id").agg(F.min("good").alias("good"), F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = pc.list_flatten(got.column("x")).to_numpy().reshape(-1, len(FEATURES))
    return train(x, got.column("good").to_numpy())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit_tables(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Ranker:
    """Fits on the labelled documents that are not held out, ``bound`` of them at most; their ids are what is broadcast."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(docs.select("doc_id", "text").join(F.broadcast(bounded_sample(ids, "doc_id", bound)), "doc_id"))


OUT = "doc_id long, score double"


def _scored(ranker: Ranker) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=TEXT):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ranker.scores(figures(batch.column("text"))))], schema=arrow_schema(OUT))

    return score


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(ranker), OUT)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = fit_tables(docs, table(spark, sf_dir, "labels"))
    return score(docs, ranker).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
