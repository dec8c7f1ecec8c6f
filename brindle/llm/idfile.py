"""Token-ID files: ids of all documents in ascending doc_id order, range-coded in checked blocks.

A file is a run of segments, a segment a row that Spark's text writer puts down, closed by a line end:
``TIDS`` and a format byte; as little-endian uint64 the numbers of documents, ids, blocks, and bytes of index, of prior and of codes;
the index (zlib: doc_ids as int64, null as the least int64, and id counts as int64); the prior of the segment's ids (zlib: shares of all ids
as uint32); of each block the number of ids, the crc32 of its ids and the length of its code as uint32; the codes; the crc32 of all before it. Files sort by the numbers in their
names (the task's, then the file's in it) as their documents do by id.

Defined results: null and empty texts are their end id alone; rows of equal ids follow one another by
text; null ids come first; an empty table gives no segments and an empty result; further columns
are ignored. Ids of 65536 and more are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import rangecoder
from brindle.llm.common import arrow_schema, chunks, new_path, table
from brindle.llm.tokens import default_path, encoder

MAGIC, END_ID = b"TIDS\x02", 0
_HEAD = struct.Struct("<5s6Q")
#: Ids that a segment holds about: as many blocks as the coder takes at once.
SEGMENT = rangecoder.BLOCK * rangecoder.LANES
#: Segments of a file, which one task reads whole (about 10 MB each).
SEGMENTS = 16
NULL_ID = -(1 << 63)
_numbers = re.compile(r"part-(\d+)-.*?-c(\d+)[^/]*$")


def file_order(path: str) -> tuple[int, int]:
    """The numbers of the task and of its file in the name that Spark's writer gives: beyond 99,999 names no longer sort as they do."""
    m = _numbers.search(path)
    return int(m[1]), int(m[2])


def make_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    freq = rangecoder.prior(ids)
    blocks = rangecoder.encode(ids, freq)
    prior = zlib.compress(freq.astype("<u4").tobytes())
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes(), 3)
    table_ = b"".join(struct.pack("<3I", n, crc, len(code)) for n, crc, code in blocks)
    codes = b"".join(code for *_, code in blocks)
    data = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), len(index), len(prior), len(codes)) + index + prior + table_ + codes
    return data + struct.pack("<I", zlib.crc32(data))


def _spans(data: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
    at = 0
    while at < len(data):
        magic, *n = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise rangecoder.Corrupt(f"no segment at {at}")
        yield at, tuple(n)
        at += _HEAD.size + n[3] + n[4] + 12 * n[2] + n[5] + 4 + 1


def read_segments(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, id counts and ids of each segment; raises Corrupt where a check fails."""
    for at, (docs, total, n_blocks, index_size, prior_size, code_size) in _spans(data):
        start = at + _HEAD.size
        table_at = start + index_size + prior_size
        code_at = table_at + 12 * n_blocks
        end = code_at + code_size
        if struct.unpack_from("<I", data, end)[0] != zlib.crc32(memoryview(data)[at:end]):
            raise rangecoder.Corrupt(f"checksum of the segment at {at}")
        index = np.frombuffer(zlib.decompress(data[start : start + index_size]), "<i8")
        freq = np.frombuffer(zlib.decompress(data[start + index_size : table_at]), "<u4")
        blocks = []
        for n, crc, size in struct.iter_unpack("<3I", data[table_at:code_at]):
            blocks.append((n, crc, data[code_at : code_at + size]))
            code_at += size
        ids = rangecoder.decode(blocks, freq)
        if len(ids) != total:
            raise rangecoder.Corrupt(f"number of ids at {at}")
        yield index[:docs], index[docs:], ids


def _written(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = make_segment(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in chunks(batches):
            ids, offsets = encode(batch.column("text"), end_id)
            held.append((batch.column("doc_id").fill_null(NULL_ID).to_numpy(), np.diff(offsets), ids))
            size += len(ids)
            if size >= SEGMENT - SEGMENT // 16:
                yield flush()
                size = 0
        if held:
            yield flush()

    return segments


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """A folder of files; ``path`` is the vocabulary file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    rows.mapInArrow(_written(path or default_path(), end_id), "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS).option("lineSep", "\n").text(out)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals = [sum(n[1] for _, n in _spans(x.as_py())) for x in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(totals, pa.int64())], schema=arrow_schema("path string, n long"))


OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decoded(batches: Iterator[pa.RecordBatch], bases: dict[str, int], with_ids: bool) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(OUT + ", ids array<int>" * with_ids)
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            base = bases[name]
            for doc_ids, counts, ids in read_segments(content.as_py()):
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)), np.int64, len(ends))
                columns = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(base + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))).cast(schema.field("ids").type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                base += len(ids)


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a folder of files; what the driver holds is a number for each file."""
    files = spark.read.format("binaryFile").load(out).where("length > 0").select("path", "content")
    totals = {r["path"]: r["n"] for r in files.mapInArrow(_totals, "path string, n long").collect()}
    bases, base = {}, 0
    for name, n in sorted(totals.items(), key=lambda x: file_order(x[0])):
        bases[name], base = base, base + n
    return files.mapInArrow(partial(_decoded, bases=bases, with_ids=with_ids), OUT + ", ids array<int>" * with_ids)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "idfile")
    write(table(spark, sf_dir, "documents"), out)
    return read(spark, out)
