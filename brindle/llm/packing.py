"""Cost-balanced packing: texts become sequences of at most ``SEQUENCE`` tokens of about equal cost.

A sequence costs ``LINEAR`` for each of its places, padded or not (projections), and ``QUADRATIC * n * n`` for each piece of n tokens in
it (attention within the piece): the linear part is the same for all, the quadratic part is what is balanced.
A text longer than half a sequence is cut evenly into as few pieces of half a sequence at most, as a longer piece by itself would cost
more than other sequences can; others stay whole. Pieces are
assigned in descending length, each to the sequence of lowest cost of all that have room for it. One that no
sequence has room for is halved and tried again, and at ``LEAST`` tokens poured into what room is left. A block of
about ``BLOCK`` tokens has ``SLACK`` more sequences than its tokens fill, so that cost and not room decides, and is padded by as
much; one of under ``FEW`` sequences has as many full ones as its tokens fill, and the rest in sequences of
powers of two, so that each ends full. Blocks are packed as they stream by, in the
task that reads them: memory is bounded by a block and nothing is shuffled.

Defined results: null and empty texts are their end id alone; repeated rows and ids are texts of
their own; ties in length keep the order of reading; an empty table gives an empty result;
further columns are ignored. A sequence id holds the task's partition and a count in it, so reruns agree.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, table
from brindle.llm.tokens import default_path, encoder

SEQUENCE, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens that a block holds at least before it is packed; tokens of a piece that isn't halved.
BLOCK, LEAST = 2 << 20, 64
#: Share of sequences beyond those that the tokens fill, and sequences from which a block has them.
SLACK, FEW = 0.01, 100
#: Bytes of text that are encoded at once.
TEXT = 1 << 20


def cost(n: int | np.ndarray) -> float | np.ndarray:
    """What a piece adds to its sequence, whose places cost ``LINEAR`` each anyway."""
    return QUADRATIC * n * n


def assign(sizes: np.ndarray, room: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(text, start, length, sequence, offset) of all pieces of the texts of these sizes."""
    total = int(sizes.sum())
    full, rest = total // room, total % room
    if full >= FEW:
        full = math.ceil(total * (1 + SLACK) / room)
        rooms = [room] * full
    else:
        rooms = [room] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    left = np.array(rooms)
    # the short ones come when the full ones have no room
    costs = np.where(np.arange(len(rooms)) < full, 0.0, cost(room) * (room + 1))
    pieces = []
    for text, size in enumerate(sizes.tolist()):
        n = max(1, -(-size // (room // 2)))
        pieces += [(size * i // n - size * (i + 1) // n, text, size * i // n) for i in range(n)]
    heapq.heapify(pieces)
    found = []
    while pieces:
        n, text, start = heapq.heappop(pieces)
        n = -n
        if not n:
            continue
        i = int(np.where(left >= n, costs, np.inf).argmin())
        if left[i] < n:
            half = n // 2 if n > LEAST else int(left[i := int(left.argmax())])
            heapq.heappush(pieces, (half - n, text, start + half))
            if n > LEAST:
                heapq.heappush(pieces, (-half, text, start))
                continue
            n = half
        found.append((text, start, n, i, rooms[i] - int(left[i])))
        left[i] -= n
        costs[i] += cost(n)
    return found


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, room: int, end_id: int, with_ids: bool, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = arrow_schema(OUT + ", ids array<int>" * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        encode = encoder(path).encode
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            names = pa.concat_arrays([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held]).astype("<u4")
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            first = np.cumsum(sizes) - sizes
            text, start, length, sequence, offset = np.array(assign(sizes, room), np.int64).T
            at = first[text] + start
            raw = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
            columns = [names.take(pa.array(text)), *map(pa.array, (start, length, crc, sizes[text], sequence + next_id, offset))]
            next_id += int(sequence.max()) + 1
            if with_ids:
                ends = np.cumsum(length)
                values = ids[np.repeat(at - (ends - length), length) + np.arange(ends[-1])].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values)).cast(schema.field("ids").type))
            held.clear()
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in chunks(batches, limit=TEXT):
            held.append((batch.column("doc_id").cast(pa.int64()), *encode(batch.column("text"), end_id)))
            if sum(len(x[1]) for x in held) >= block:
                yield from flush()
        if held:
            yield from flush()

    return pack


def pack(docs: DataFrame, path: str | None = None, room: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """A row for each piece; ``with_ids`` adds the piece's ids. ``path`` is the vocabulary file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packed(path or default_path(), room, end_id, with_ids, block), OUT + ", ids array<int>" * with_ids)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
