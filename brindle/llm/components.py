"""Connected components of a graph of links, by alternating large-star and small-star passes.

Links are contracted within each task, some at a time, to the stars of what they connect there, before
each pass; what one task contracts at once needs no pass. Each pass
is written to the shared folder, so nothing hangs on an executor. The least node of each component is its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialized, remove

#: Links that a task contracts at once.
LOCAL = 200_000


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least(both).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("k")).where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    least = _least(down)
    held = down.join(least.withColumnsRenamed({"u": "k"}), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return held.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        links = np.concatenate(held)
        held.clear()
        nodes, at = np.unique(links, return_inverse=True)
        parent = list(range(len(nodes)))
        for pair in at.reshape(-1, 2).tolist():
            roots = []
            for i in pair:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                roots.append(i)
            parent[max(roots)] = min(roots)
        for i in range(len(parent)):  # a parent is less than its child
            parent[i] = parent[parent[i]]
        rest = np.flatnonzero(np.array(parent) != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[np.array(parent)[rest]])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()], axis=1))
        if sum(map(len, held)) >= 2 * LOCAL:
            yield stars()
    if held:
        yield stars()


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same, each task's by themselves. Not for links that a Python kernel makes in the same stage: its tasks would run two workers each."""
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contracted, "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether every node either points at one other or is pointed at."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select(F.col("b").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty()


def connected(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long); label is the least node reachable."""
    spark = links.sparkSession
    edges, path = materialized(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        tasks = 1 + edges.count() // LOCAL
        step, at = materialized(contracted(edges.coalesce(tasks)), "edges")
        remove(spark, path)
        edges, path = step, at
        if tasks == 1 or _stars(edges):
            break
        step, at = materialized(_small(_large(edges)), "edges")
        remove(spark, path)
        edges, path = step, at
    else:
        raise RuntimeError(f"components didn't settle in {most} passes")
    # stars now: every node but the least points at the least
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
