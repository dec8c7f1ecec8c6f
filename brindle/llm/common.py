"""Helpers that the operators of this subpackage share: tables, shared folders, word kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python kernel works on at once; arrays built from it stay under about 200 MB.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one if it runs on one machine."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialized(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables of the shared folder that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices record batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Gives memory that Arrow holds free back to the machine: an idle worker keeps it else, while the next stage needs it."""
    pa.default_memory_pool().release_unused()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and the row offsets into them (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if pa.types.is_large_list(lists.type):
        offsets = lists.offsets.to_numpy().astype(np.int64)
    else:
        offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return flat.filter(keep), kept[offsets]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 (fixed constants), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name type, ...``; workers have no session to parse it with."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """The rows with the ``bound`` smallest hashes of ``key`` (ties may add some); alike on every run."""
    from pyspark.sql import functions as F

    hashed = rows.withColumn("__h", F.xxhash64(F.lit(17), key))
    top = hashed.select("__h").orderBy("__h").limit(bound).agg(F.max("__h"), F.count("__h")).first()
    if top[1] < bound:
        return rows
    return hashed.where(F.col("__h") <= top[0]).drop("__h")


def vocabulary(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that no column of theirs meets one of an operator's."""
    from pyspark.sql import functions as F

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
