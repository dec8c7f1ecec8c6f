"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words without marks around them and their prefixes of 4 to 8 letters, hashed into
``BUCKETS``, and the text's length class. A term's value is log2(1 + count). Every term of the labelled
rows enters the machine, ``BUCKETS`` at most, whatever it tells by itself; the machine
learns a weight and a vector of ``RANK`` factors for each; the dot product of two vectors is the weight of
the pair, so a word can count only beside another, or only in a short text.

Defined results: null and empty texts have no words and are scored by their length class alone; with
no labelled row, or one class only, the score is the share of toxic rows (0.0 without rows); a
document with several labels counts as toxic if one is; of rows that share an id, one is learnt from; null labels are no labels; repeated rows
have a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, bounded_sample, chunks, release, table, vocabulary, words

#: Most labelled rows that the model is fitted on; hash buckets; factors of a term; passes of the fit; rows of a step;
#: rows of a term (a tenth of the sample at most) at which its factors go half as far; standard errors at which its weight does.
SAMPLE, BUCKETS, RANK, EPOCHS, ROWS, RARE, SURE = 12_000, 1 << 22, 6, 8, 256, 300, 4
PREFIXES = range(4, 9)
THRESHOLD = 0.3
#: Words whose terms a worker remembers; bytes of text whose terms it counts at once (each word has up to six).
MEMORY, TEXT = 100_000, 1 << 20

_edges = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_seen: dict[str, np.ndarray] = {}


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def terms(word: str) -> list[int]:
    """Buckets of a word and of its prefixes."""
    word = _edges.sub("", word.lower())
    if not word:
        return []
    return [_bucket("w" + word), *(_bucket(f"{n}{word[:n]}") for n in PREFIXES if n < len(word))]


def _ragged(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return (np.concatenate(values) if len(values) else np.zeros(0, np.int64)).astype(np.int64), sizes


def counted(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of a block: buckets, or positions in the sorted ``known`` without terms that the sample lacks."""
    flat, offsets = words(texts)
    rows = len(texts)
    n_words = np.diff(offsets)
    # the length class, as a term of its own
    length = np.array([_bucket(f"len{i}") for i in range(64)])[np.frompyfunc(int.bit_length, 1, 1)(n_words).astype(np.int64)] if rows else np.zeros(0, np.int64)
    if len(flat):
        code, vocab = vocabulary(flat)
        if len(_seen) > MEMORY:
            _seen.clear()
        per = []
        for w in vocab.to_pylist():
            if (t := _seen.get(w)) is None:
                t = _seen[w] = np.array(terms(w), np.int32)
            per.append(t)
        values, sizes = _ragged(per)
        used = sizes > 0
        text = np.repeat(np.arange(rows), n_words)
        keep = used[code]
        code, text = code[keep], text[keep]
        starts, many = np.cumsum(sizes) - sizes, sizes[code]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found = values[np.repeat(starts[code], many) + inner]
        row = np.repeat(text, many)
    else:
        row = found = np.zeros(0, np.int64)
    row, found = np.append(row, np.arange(rows)), np.append(found, length)
    key, n = np.unique(row * BUCKETS + found, return_counts=True)
    row, found = key // BUCKETS, key % BUCKETS
    if known is not None and len(known):
        k = np.minimum(np.searchsorted(known, found), len(known) - 1)
        keep = known[k] == found
        row, found, n = row[keep], k[keep], n[keep]
    elif known is not None:
        row = found = n = np.zeros(0, np.int64)
    return row, found, n


def _idle() -> None:
    """The worker may stay while other work needs its memory."""
    _seen.clear()
    release()


ROWS_OUT = "doc_id long, toxic int, terms binary, n binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and counts as 32-bit integers, one after the other in a binary column each."""
    schema = arrow_schema(ROWS_OUT)
    for batch in chunks(batches, limit=TEXT):
        row, term, n = counted(batch.column("text"))
        offs = pa.py_buffer((4 * np.searchsorted(row, np.arange(batch.num_rows + 1))).astype(np.int32))
        packed = [pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, offs, pa.py_buffer(x.astype("<i4"))]) for x in (term, n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), *packed], schema=schema)
    batch = None
    _idle()


class Machine:
    """Sorted term buckets, bias, weights [terms] and factors [terms, RANK]."""

    def __init__(self, known: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.known, self.bias, self.weights, self.factors = known, bias, weights, factors

    def scores(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        x = np.log2(1.0 + n)
        total = self.bias + np.bincount(row, weights=self.weights[term] * x, minlength=rows)
        for f in range(self.factors.shape[1]):
            vx = self.factors[term, f] * x
            total += 0.5 * (np.bincount(row, weights=vx, minlength=rows) ** 2 - np.bincount(row, weights=vx * vx, minlength=rows))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


class _Batch:
    """Some rows of the sample: their terms, each once, and the entries both by row and by term."""

    def __init__(self, offsets: np.ndarray, term: np.ndarray, x: np.ndarray, y: np.ndarray):
        """``term`` and ``x`` are kept, not copied: places among the batch's terms take the terms' memory."""
        self.terms, term[:] = np.unique(term, return_inverse=True)
        self.at, self.x, self.y = term, x, y
        self.sizes = np.diff(offsets)
        self.rows = np.flatnonzero(self.sizes)
        self.starts = offsets[self.rows]
        self.order = np.argsort(self.at, kind="stable").astype(np.int32)
        self.cuts = np.searchsorted(self.at[self.order], np.arange(len(self.terms)))

    def by_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.y), *values.shape[1:]), np.float32)
        if len(values):
            out[self.rows] = np.add.reduceat(values, self.starts)
        return out

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.cuts) if len(values) else values[:0]


def scales(many: int, toxic: np.ndarray, term: np.ndarray, y: np.ndarray, rare: float, sure: float) -> np.ndarray:
    """How far each term's weight and factors go as they are learnt; never 0.

    By how surely the term alone tells the classes apart (log-odds against their error), or by the rows that
    hold it, whichever is more: else the rows of the sample are known by their many rare words.
    """
    n, pos = np.zeros(many, np.int64), np.zeros(many)
    for k in range(0, len(term), 1 << 19):  # counting widens what it counts
        n += np.bincount(term[k : k + (1 << 19)], minlength=many)
        pos += np.bincount(term[k : k + (1 << 19)], weights=toxic[k : k + (1 << 19)], minlength=many)
    a, b = pos + 0.5, n - pos + 0.5
    c, d = y.sum() + 1 - a, len(y) - y.sum() + 1 - b
    z = (np.log(a * d / (b * c)) ** 2 / (1 / a + 1 / b + 1 / c + 1 / d) / sure**2) ** 2
    return np.maximum(z / (z + 1), n / (n + rare)).astype(np.float32)[:, None]


def train(known: np.ndarray, x: np.ndarray | list[np.ndarray], y: np.ndarray, order: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = 0.03, decay: float = 2e-4, seed: int = 7, rows: int = ROWS, rare: float = RARE, sure: float = SURE) -> Machine:
    """Adam on the logistic loss, ``rows`` rows a step, of ``x``: [rows, terms], or its row offsets, terms and values, which are taken from the list.

    Rows are mixed from ``order``, if given, so that the fit doesn't hang on how they came.
    """
    if isinstance(x, np.ndarray):
        r, term = np.nonzero(x)
        x = [np.searchsorted(r, np.arange(len(x) + 1)), term, x[r, term]]
    value, term, offsets = x.pop(), x.pop(), x.pop()
    scale = scales(len(known), np.repeat(y, np.diff(offsets)), term, y, min(rare, 0.1 * len(y)), sure)
    rng = np.random.default_rng(seed)
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    # weight and factors of a term side by side
    p = rng.normal(0, 0.02, (len(known), 1 + RANK)).astype(np.float32)
    p[:, 0] = 0
    bias, mb, sb = np.float32(base), 0.0, 0.0
    batches = []
    mixed = rng.permutation(len(y)) if order is None else order[rng.permutation(len(y))]
    # entries in the order of the batches, each batch a part of one array
    parts = np.array_split(mixed, max(1, -(-len(y) // rows)))
    inner, cuts = np.empty(len(term), np.int32), [0]
    for part in parts:
        n = offsets[part + 1] - offsets[part]
        ends = np.append(0, np.cumsum(n))
        inner[cuts[-1] : cuts[-1] + ends[-1]] = np.repeat(offsets[part] - ends[:-1], n) + np.arange(ends[-1])
        cuts.append(cuts[-1] + int(ends[-1]))
    term = term.astype(np.int32, copy=False)[inner]
    value = value.astype(np.float32, copy=False)[inner]
    del inner
    for part, a, b in zip(parts, cuts, cuts[1:], strict=False):
        batches.append(_Batch(np.append(0, np.cumsum(offsets[part + 1] - offsets[part])), term[a:b], value[a:b], y[part]))
    del term, value
    m, s = np.zeros_like(p), np.zeros_like(p)
    # a term that few batches hold is held back by as much a pass as one of all batches
    times = np.zeros(len(known), np.int64)
    for b in batches:
        times[b.terms] += 1
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            own, by, x1 = p[b.terms], scale[b.terms], b.x[:, None]
            vx = (own * by)[b.at] * x1
            sums = b.by_row(vx)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - b.by_row((vx[:, 1:] ** 2).sum(1)))
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - b.y) / len(b.y)).astype(np.float32)
            g = np.repeat(sums, b.sizes, axis=0) - vx
            g[:, 0] = 1
            g *= x1 * np.repeat(e, b.sizes)[:, None]
            g = b.by_term(g) * by + own * (decay * len(batches) / times[b.terms])[:, None].astype(np.float32)
            step += 1
            now, c1, c2 = rate * (1 - 0.95 * step / steps), 1 - 0.9**step, 1 - 0.999**step
            m[b.terms] = mt = 0.9 * m[b.terms] + 0.1 * g
            s[b.terms] = st = 0.999 * s[b.terms] + 0.001 * g * g
            p[b.terms] = own - now * (mt / c1) / (np.sqrt(st / c2) + 1e-8)
            mb, sb = 0.9 * mb + 0.1 * float(e.sum()), 0.999 * sb + 0.001 * float(e.sum()) ** 2
            bias -= np.float32(now * (mb / c1) / (np.sqrt(sb / c2) + 1e-8))
    p *= scale
    return Machine(known, float(bias), p[:, 0].copy(), p[:, 1:].copy())


def fit(labelled: DataFrame) -> Machine:
    """Fits on rows with ``doc_id``, ``text`` and ``toxic``, those of one id counting once (toxic if one is; the least terms); all their terms enter."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    n, pos = rows.agg(F.count("toxic"), F.sum("toxic")).first()
    none = np.zeros(0, np.int64)
    if not n or pos in (0, n):
        share = (pos or 0) / n if n else 0.0
        return Machine(none, 30.0 if share == 1 else -30.0, np.zeros(0), np.zeros((0, RANK)))
    once = rows.mapInArrow(_rows, ROWS_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("terms", "n")).alias("x"))
    ids, y, sizes, used = [], [], [], 0
    term, value = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.float32)
    # a partition at a time: neither the JVM nor Python holds the sample twice
    for r in once.select("doc_id", "toxic", "x.terms", "x.n").toLocalIterator():
        ids.append(r[0])
        y.append(r[1])
        sizes.append(len(r[2]) // 4)
        if used + sizes[-1] > len(term):
            more = max(len(term) // 8, sizes[-1])
            term.resize(len(term) + more, refcheck=False)
            value.resize(len(value) + more, refcheck=False)
        term[used : used + sizes[-1]] = np.frombuffer(r[2], "<i4")
        value[used : used + sizes[-1]] = np.log2(1.0 + np.frombuffer(r[3], "<i4").astype(np.float32))
        used += sizes[-1]
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    term.resize(used, refcheck=False)
    value.resize(used, refcheck=False)
    y = np.array(y, np.float32)
    held = np.zeros(BUCKETS, bool)
    held[term] = True
    np.take(np.cumsum(held, dtype=np.int32) - 1, term, out=term, mode="clip")
    x = [offsets, term, value]
    del term, value
    return train(np.flatnonzero(held).astype(np.int32), x, y, order)


OUT = "doc_id long, score double"


def _scored(machine: Machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _seen.clear()
        for batch in chunks(batches, limit=TEXT):
            row, term, n = counted(batch.column("text"), machine.known)
            got = machine.scores(row, term, n, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(got)], schema=arrow_schema(OUT))
        batch = None
        _idle()

    return score


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(machine), OUT)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit_tables(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Machine:
    """Fits on the labelled documents that are not held out; the sample of ids is what is broadcast."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_sample(ids, "doc_id", bound)
    return fit(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit_tables(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _clean(machine: Machine, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _seen.clear()
        for batch in chunks(batches, limit=TEXT):
            got = machine.scores(*counted(batch.column("text"), machine.known), batch.num_rows)
            yield batch.filter(pa.array(got < threshold))
        batch = None
        _idle()

    return keep


def clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return docs.mapInArrow(_clean(machine, threshold), docs.schema)
