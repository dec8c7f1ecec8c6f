"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections of a text.

Leaves are pieces: a paragraph (a ``\\n``-ended line) is cut after a word whose checksum is a
multiple of ``PIECE``, so that an edit moves no cut elsewhere and one-paragraph texts have
branches too. Pieces hash into paragraphs, paragraphs into sections (ended by a blank
paragraph, or by a paragraph whose digest is a multiple of ``SECTION``), sections into the
root. A digest is that of its children's printed digests alone, so any branch can be checked by itself
(``verified``). Equal roots mean equal texts; descending where digests differ measures what is
shared (``likeness``) and locates edits (``differences``).

A fingerprint is text: ``root|section;section``, a section ``digest/paragraph/paragraph``, a
paragraph ``digest:length-leaf,length-leaf``. Leaves have 64 bits, branches 96, the root 256.

Defined results: null and empty texts have the tree of the empty text, alike 1.0 to one another
and 0.0 to any text; repeated rows and ids have a row each; ids that tie follow one another by
text; null ids come last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, record_batch, table

#: Mean words in a piece; mean paragraphs in a section; longest piece in words.
PIECE, SECTION, PIECE_MAX = 6, 8, 64
#: Rows that a range of ids holds about, and the most ranges: the bound of what is broadcast.
RANGE_ROWS, RANGES = 4000, 10_000

_word = re.compile(rb"[^ \t-\r]*[ \t-\r]*")


def _hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pieces(paragraph: bytes) -> list[bytes]:
    """Content-defined pieces of a paragraph, whose concatenation it is."""
    found, held, n = [], [], 0
    for word in _word.findall(paragraph):
        held.append(word)
        n += 1
        if zlib.crc32(word) % PIECE == 0 or n == PIECE_MAX:
            found.append(b"".join(held))
            held, n = [], 0
    if held and (last := b"".join(held)):
        found.append(last)
    return found


def parent(children: list[str], size: int = 24) -> str:
    """A digest of the printed digests of its children alone."""
    return _hash("/".join(children).encode())[:size]


def fingerprint(text: str | None) -> str:
    paragraphs = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    sections: list[list[tuple[str, str]]] = [[]]
    for p in paragraphs:
        leaves = [f"{len(x):x}-{_hash(x)[:16]}" for x in pieces(p)]
        digest = parent(leaves)
        sections[-1].append((digest, ",".join(leaves)))
        if not p.strip() or int(digest[:8], 16) % SECTION == 0:
            sections.append([])
    told = [(parent([d for d, _ in s]), s) for s in sections if s]
    root = parent([d for d, _ in told], 64)
    return f"{root}|{';'.join('/'.join([top, *(f'{d}:{x}' for d, x in s)]) for top, s in told)}"


def sections_of(fp: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(digest, paragraphs) of each section, a paragraph (digest, its leaves as printed)."""
    found = []
    for section in fp.partition("|")[2].split(";"):
        top, *rest = section.split("/")
        found.append((top, [(p[:24], p[25:]) for p in rest]))
    return found


def verified(fp: str) -> bool:
    """Whether every digest of a fingerprint is that of its children."""
    told = sections_of(fp)
    return fp[:64] == parent([d for d, _ in told], 64) and all(top == parent([d for d, _ in s]) and all(d == parent(x.split(",") if x else []) for d, x in s) for top, s in told)


def _bytes(leaves: str) -> int:
    return sum(int(x.partition("-")[0], 16) for x in leaves.split(",")) if leaves else 0


def _apart(a: list, b: list) -> tuple[list, list, list]:
    """What both lists of (digest, ..) hold, as often as both do, and the rest of either."""
    free: dict[str, list] = {}
    for x in b:
        free.setdefault(x[0], []).append(x)
    both, left = [], []
    for x in a:
        if free.get(x[0]):
            free[x[0]].pop()
            both.append(x)
        else:
            left.append(x)
    return both, left, [x for rest in free.values() for x in rest]


def likeness(a: str, b: str) -> float:
    """Bytes under branches that both trees have, of the mean of both totals; 1.0 for equal roots.

    Equal sections count whole, the others are descended to their paragraphs, and of these those that differ to their leaves.
    """
    if a[:64] == b[:64]:
        return 1.0
    weigh = lambda paragraphs: sum(_bytes(x) for _, x in paragraphs)
    both, x, y = _apart(sections_of(a), sections_of(b))
    shared = sum(weigh(s) for _, s in both)
    equal, p, q = _apart([d for _, s in x for d in s], [d for _, s in y for d in s])
    shared += weigh(equal)
    rest_a, rest_b = (Counter(leaf for _, s in t for leaf in s.split(",") if leaf) for t in (p, q))
    common = sum(n * int(leaf.partition("-")[0], 16) for leaf, n in (rest_a & rest_b).items())
    total = 2 * shared + weigh(p) + weigh(q)
    return 2.0 * (shared + common) / total if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``b`` whose branch ``a`` lacks; only differing sections are descended."""
    if a[:64] == b[:64]:
        return []
    known = Counter(s.split("/")[0] for s in a.partition("|")[2].split(";"))
    own = [s.split("/") for s in b.partition("|")[2].split(";")]
    rest = Counter(p.partition(":")[0] for s in a.partition("|")[2].split(";") for p in s.split("/")[1:])
    found = []
    for i, s in enumerate(own):
        if known[s[0]] > 0:
            known[s[0]] -= 1
            continue
        for j, p in enumerate(s[1:]):
            if rest[d := p.partition(":")[0]] > 0:
                rest[d] -= 1
            else:
                found.append((i, j))
    return found


def edited(text: str, following: str) -> str:
    """The text with its last third (code points, rounded down) replaced by the first as many of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and descending id; a part's last row is the copied head of the next."""
    schema = arrow_schema(OUT)
    before = None
    rows: list[tuple] = []
    held = 0
    for batch in chunks(batches):
        for part, doc_id, text, copied in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if before and before[0] == part and before[4]:
                continue  # further rows that tie with the head
            text = text or ""
            own = fingerprint(text)
            this = (part, doc_id, text, own, copied)
            if before and before[0] == part:
                changed = edited(before[2], text)
                fp = fingerprint(changed)
                rows.append((before[1], len(before[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), before[3], fp, likeness(before[3], fp), likeness(before[3], own), ",".join(f"{i}.{j}" for i, j in differences(before[3], fp))))
                held += len(before[3]) + len(fp)
            before = this
            if held > 4 << 20:
                yield record_batch(rows, schema)
                rows, held = [], 0
    if rows:
        yield record_batch(rows, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, their likeness to the edited text's and to the next document's, and where the edited text differs (``section.paragraph``, from 0).

    One shuffle: ids are cut into ranges, each range also gets the first row of the range
    that follows, so every row meets its successor in its own task.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    base = docs.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    ranges = min(RANGES, n // RANGE_ROWS + 1)
    cuts = sorted(set(base.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    edges = [-float("inf"), *cuts, float("inf")]
    if len(edges) > 2:
        from pyspark.ml.feature import Bucketizer

        numbered = Bucketizer(splits=edges, inputCol="kd", outputCol="pd").transform(base.withColumn("kd", F.col("k").cast("double"))).withColumn("part", F.col("pd").cast("int")).drop("kd", "pd")
    else:
        numbered = base.withColumn("part", F.lit(0))
    heads = sorted(((r["part"], r["k"]) for r in numbered.groupBy("part").agg(F.max("k").alias("k")).collect()), reverse=True)
    copies = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]  # the first range's head follows the last range
    to = spark.createDataFrame(copies, "k long, also int")
    spread = (
        numbered.join(F.broadcast(to), "k", "left")
        .select("k", "doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("copied")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("copied")), F.struct(F.col("also").alias("part"), F.lit(True).alias("copied"))))).alias("x"))
        .select(F.col("x.part").alias("part"), "doc_id", "text", F.col("x.copied").alias("copied"), "k")
    )
    parts = max(1, len(heads))
    return (
        spread.repartition(parts, "part")
        .sortWithinPartitions("part", "copied", F.desc("k"), F.asc_nulls_first("text"))
        .select("part", "doc_id", "text", "copied")
        .mapInArrow(_compare, OUT)
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
