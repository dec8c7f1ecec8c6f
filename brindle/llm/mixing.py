"""Mixing sources to target weights by the cube method.

Sources share ``budget`` times all words by weight, none more than ``cap`` times its own. A source's
documents are each taken ``floor(target / size)`` times, and once more with the fraction left as inclusion
probability. The cube method decides which: in blocks of a source's documents, the probabilities of three
documents at a time move along the direction that changes neither their sum nor their expected words, until one is 0 or 1.
Two documents of a block stay undecided at most; those of all blocks of a source meet in the next round, and at
last a dozen of a source land where words come nearest to the expected. Hashes of ids stand for random numbers, so reruns agree.

Defined results: null texts and texts without words have size 0 and are never short of a target;
a null source is a source, the last; sources of size 0 have target 0; repeated rows are documents of
their own; an empty table gives an empty result; further columns are ignored by ``mix``, kept by ``mixed``.
The driver holds a row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, materialize, table

WEIGHTS, BUDGET, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of a block about; most sources that are broadcast.
CHUNK, SMALL = 4000, 100_000
#: Documents of a source, besides two, that the landing decides.
LANDING = 14
_SURE = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> dict[str | None, float]:
    """Words of each source: shares by weight, held at ``cap`` times its size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, found = budget * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return found | {s: left * weight[s] / total for s in free}
        for s in over:
            found[s] = cap * float(sizes[s])
        left -= sum(found[s] for s in over)
        free = [s for s in free if s not in found]
    return found


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities after moving all but two at most to 0 or 1; their sum and expected size stay."""
    p = p.astype(float).copy()
    size, draw = size.astype(float), draw.tolist()
    held: list[int] = []
    for k in np.flatnonzero((p > _SURE) & (p < 1 - _SURE)).tolist():
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        v = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, d in zip(held, v, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if draw[k] * (up + down) < down else -down
        for i, d in zip(held, v, strict=True):
            p[i] = min(max(p[i] + step * d, 0.0), 1.0)
            if p[i] < _SURE or p[i] > 1 - _SURE:
                p[i] = round(p[i])
        if len(kept := [i for i in held if 0 < p[i] < 1]) == 3:  # rounding kept all inside: the nearest yields
            i = min(kept, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = round(p[i])
            kept.remove(i)
        held = kept
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The undecided documents, few, set to 0 or 1: words nearest to the expected while documents are off by two at most."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = np.abs(bits.sum(1) - p[open_].sum()) > 2
        p[open_] = bits[np.lexsort((np.abs(bits @ size[open_] - (p[open_] * size[open_]).sum()), off))[0]]
    return p


FLOWN = "sid int, chunk long, doc_id long, key long, size long, p double"


def _flown(last: bool):  # noqa: ANN202
    schema = arrow_schema(FLOWN)

    def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        size = batch.column("size").to_numpy()
        draw = (batch.column("key").to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
        p = batch.column("p").to_numpy().copy()
        if last:  # the longest stay for the landing: they can make up for any that the flight leaves
            fly_ = np.sort(np.argsort(size, kind="stable")[:-LANDING])
            p[fly_] = flight(p[fly_], size[fly_], draw[fly_])
            p = landing(p, size)
        else:
            p = flight(p, size, draw)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(p)], schema=schema)

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sid, chunk = batch.column("sid").to_numpy(), batch.column("chunk").to_numpy()
            cuts = np.flatnonzero((sid[1:] != sid[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and now != (sid[a], chunk[a]):
                    yield close(held)
                    held = []
                now = (sid[a], chunk[a])
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield close(held)

    return fly


def _cube(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (FLOWN, chunk the number of the source's rows) with all probabilities 0 or 1."""
    done = []
    while True:
        last = most <= CHUNK
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "doc_id", F.lit(3)), F.ceil(F.col("chunk") / CHUNK).cast("long"))) if not last else rows.withColumn("chunk", F.lit(0).cast("long"))
        flown = dealt.repartition("sid", "chunk").sortWithinPartitions("sid", "chunk", "key", "doc_id", "size").mapInArrow(_flown(last), FLOWN)
        if last:
            return flown if not done else _union([*done, flown])
        flown = materialize(flown, "flight")
        done.append(flown.where("p = 0 or p = 1"))
        rest = flown.where("p > 0 and p < 1")
        counts = rest.groupBy("sid").agg(F.count(F.lit(1)).alias("chunk"))
        most = counts.agg(F.max("chunk")).first()[0] or 0
        rows = rest.drop("chunk").join(counts, "sid").select("sid", "chunk", "doc_id", "key", "size", "p")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole


def n_words(text: F.Column) -> F.Column:
    return F.size(F.split(F.concat(F.lit("x "), F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), r"[\x20\x09-\x0D]+")) - F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), 1).otherwise(2)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, key: F.Column | None = None) -> DataFrame:
    """doc_id, key, size, source_size, target, copies and taken (copies * size) of each document."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    sized = materialize(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).cast("long").alias("size"), (F.xxhash64(F.lit(11), doc_id) if key is None else key).alias("key")), "sizes")
    found = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    want = targets({s: size for s, (size, _) in found.items()}, weights, budget, cap)
    rows = [(i, s, size, n, want[s], int(want[s] / size + 1e-12) if size else 0, max(want[s] / size - int(want[s] / size + 1e-12), 0.0) if size else 0.0) for i, (s, (size, n)) in enumerate(sorted(found.items(), key=lambda x: (x[0] is None, x[0] or "")))]
    sources = spark.createDataFrame(rows, "sid int, name string, source_size long, n long, target double, whole int, p double")
    small = F.broadcast(sources) if len(rows) <= SMALL else sources
    open_ = sized.join(small, F.col("source").eqNullSafe(F.col("name"))).select("sid", F.col("n").alias("chunk"), "doc_id", "key", "size", "p")
    decided = _cube(open_, max((n for _, n in found.values()), default=0))
    told = F.broadcast(sources.drop("n", "p")) if len(rows) <= SMALL else sources.drop("n", "p")
    return decided.join(told, "sid").withColumn("copies", (F.col("whole") + F.col("p")).cast("int")).select("doc_id", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The documents, each as often as the mix takes it; columns stay."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    taken = mix(docs, key=key, **options).groupBy("doc_id", "key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    once = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("hash")).dropDuplicates(["id", "hash"])
    joined = once.join(taken, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
