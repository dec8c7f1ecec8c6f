"""Tables that loops write for themselves: in the folder that driver and executors share, never in one executor's memory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str = "graph") -> str:
    """A new folder under the one that driver and executors share; where the session names none, a temporary one if it runs on one machine."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/brindle/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The table, written under ``folder`` and read again: lineage ends there, and lost executors are no loss."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def summed(rows: DataFrame, kernel: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum of ``size`` numbers that the kernel gives for parts of the rows: added up by task, then by groups of tasks, then here."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = None
        for g in kernel(batches):
            total = g.ravel() if total is None else total + g.ravel()
        if total is not None:
            context = TaskContext.get()
            yield pd.DataFrame({"part": [context.partitionId() if context else 0], "g": [total.astype(float).tobytes()]})

    def added(key, pdf: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"part": [key[0]], "g": [sum(np.frombuffer(b) for b in pdf["g"]).tobytes()]})

    grouped = rows.mapInPandas(partial, "part int, g binary").withColumn("part", F.pmod("part", F.lit(16))).groupBy("part").applyInPandas(added, "part int, g binary")
    total = np.zeros(size)
    for r in grouped.toLocalIterator():
        total += np.frombuffer(r["g"])
    return total
