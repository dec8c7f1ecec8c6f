"""WARC: a writer of gzip-member archives, and a salvage reader.

The reader takes members and plain records in order. Where one fails (inflation, checksum, version line,
header, length, record end or digest), it searches for the next member or version line that
passes, goes on from there, and logs the bytes between as a quarantined gap with the reason. It searches
the inflated bytes of a member in the same way: of a member that holds several records, or breaks off, the
records that pass are kept (of a broken member those with a digest), and the member is logged.

Archives are written by Spark's text writer, so any store that Spark writes will do: each
row is one member's bytes, and the separator that the writer puts after a row is an empty member.

Defined results: null html is an empty payload; equal payloads of at least ``MIN_REVISIT`` bytes are
stored once, with the smallest page_id (all rows of that id, if it repeats), the others refer to it;
a null page_id is stored as such and never referred to unless its payload has no other id; repeated rows have a
record each; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, materialize, new_path, record_batch, table

MIN_REVISIT = 100
MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
#: A gzip member of no bytes (a fixed value of that format).
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Bytes that are inflated at once.
STEP = 1 << 12
#: What ends a header: its blank line, or another record's version line, before which it has no end.
_head_end = re.compile(rb"\r\n(?:\r\n|WARC/1\.)")
#: Compressed bytes of an archive about, and most records; a task reads one whole, and holds one member inflated at a time.
ARCHIVE, RECORDS = 32 << 20, 8192
DATE = "2024-01-01T00:00:00Z"


def _member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The bytes of a response record, or of a revisit record if ``refers_to`` is given."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c for c in url or "about:blank" if c not in "\r\n"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block + END


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at ``at``; raises Damaged where a check fails."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    if not (m := _head_end.search(data, at)) or m[0] != END:
        raise Damaged("header without end")
    stop = m.start()
    head: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (length := head.get("content-length", "")).isascii() or not length.isdigit():
        raise Damaged("content length")
    start = stop + len(END)
    end = start + int(length)
    if end + len(END) > len(data):
        raise Damaged("truncated")
    if data[end : end + len(END)] != END:
        raise Damaged("record end")
    block = data[start:end]
    if (kind := head.get("warc-block-digest", "").partition(":"))[0] == "sha256" and hashlib.sha256(block).hexdigest() != kind[2]:
        raise Damaged("block digest")
    return head, block, end + len(END)


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at ``at`` inflates to, its end, and why it breaks off if it does."""
    z, view, got = zlib.decompressobj(31), memoryview(data), []
    try:
        # by steps, since what a step leaves over is copied
        while not z.eof and at < len(data):
            got.append(z.decompress(view[at : at + STEP]))
            at += min(STEP, len(data) - at)
    except zlib.error:
        return b"".join(got), at, "inflation"
    return b"".join(got), at - len(z.unused_data), None if z.eof else "truncated member"


Found = tuple[int, dict[str, str], bytes]


def _plain(data: bytes) -> tuple[list[Found], list[tuple[int, int, str]]]:
    """Records and gaps of inflated bytes."""
    records, gaps, at = [], [], 0
    while at < len(data):
        try:
            head, block, end = parse_record(data, at)
        except Damaged as e:
            if (end := data.find(VERSION, at + 1)) < 0:
                end = len(data)
            if gaps and gaps[-1][1] == at:
                gaps[-1] = (gaps[-1][0], end, gaps[-1][2])
            else:
                gaps.append((at, end, str(e)))
        else:
            records.append((at, head, block))
        at = end
    return records, gaps


def _take(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int, str | None]:
    """The records of the member or the plain record at ``at``, its end, and what is wrong inside; raises Damaged where no record passes."""
    if not data.startswith(MAGIC, at):
        head, block, end = parse_record(data, at)
        return [(head, block)], end, None
    got, end, broken = _inflated(data, at)
    records, gaps = _plain(got)
    if broken:
        records = [x for x in records if "warc-block-digest" in x[1]]
    wrong = broken or (gaps[0][2] if gaps else None)
    if wrong and not records:
        raise Damaged(wrong)
    # a broken member's end isn't known: the search goes on behind its first byte
    return [x[1:] for x in records], at + 1 if broken else end, wrong and f"{wrong}, {len(records)} records kept"


def salvaged(data: bytes) -> Iterator[Found | tuple[int, int, str]]:
    """(offset, headers, block) of every record that passes, and (start, end, reason) of the gaps between, a member at a time."""
    at, size = 0, len(data)
    marks = {MAGIC: -1, VERSION: -1}
    while at < size:
        try:
            found, end, wrong = _take(data, at)
        except Damaged as e:
            found, end, wrong = [], at + 1, str(e)
        for head, block in found:
            yield at, head, block
        del found
        start = at
        if wrong and end == at + 1:
            while end < size:
                for mark, known in marks.items():
                    if known < end:
                        marks[mark] = k if (k := data.find(mark, end)) >= 0 else size
                if (end := min(marks.values())) < size:
                    try:
                        _take(data, end)
                        break
                    except Damaged:
                        end += 1
        at = min(end, size)
        if wrong:
            yield start, at, wrong


def salvage(data: bytes) -> tuple[list[Found], list[tuple[int, int, str]]]:
    """Records and gaps of ``salvaged``, all at once."""
    every = list(salvaged(data))
    return [x for x in every if isinstance(x[1], dict)], [x for x in every if not isinstance(x[1], dict)]


def roles(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the rows that revisit another, once each."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).where(F.col("size") >= MIN_REVISIT).select("page_id", "digest")
    # written, so that Spark sees both sides of the join as shuffles and splits the digests that many rows share
    groups = materialize(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "warc-groups")
    return keyed.join(groups, "digest").where("page_id is null or page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))


def _members(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Members, and the number of the task's archive that each goes to."""
    archive, used = 0, 0
    for batch in chunks(batches, "html"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)
        members, where = [], []
        for p, u, h, r in rows:
            members.append(_member(make_record(p, u, (h or "").encode("utf-8", "surrogatepass"), r)))
            if used and used + len(members[-1]) > limit:
                archive, used = archive + 1, 0
            used += len(members[-1])
            where.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(where, pa.int32())], ["value", "archive"])


def write(pages: DataFrame, path: str, limit: int = ARCHIVE) -> None:
    """A folder of archives, a record a row, each of ``limit`` compressed bytes and ``RECORDS`` records at most, or of one record."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("digest", digest)
    other = roles(pages).withColumnsRenamed({"page_id": "id", "digest": "d"})
    joined = rows.join(other, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    made = joined.select("page_id", "url", "html", "refers_to").mapInArrow(partial(_members, limit=limit), "value binary, archive int")
    made.select(F.col("value").cast("string").alias("value"), "archive").write.partitionBy("archive").option("maxRecordsPerFile", RECORDS).option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(path)


RECORD = "file string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
GAP = "file string, start long, stop long, reason string"


def _payload(block: bytes) -> bytes:
    return block.partition(END)[2]


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool = True) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(RECORD)
    for batch in batches:
        for i in range(batch.num_rows):
            name = batch.column("path")[i].as_py()
            rows, held = [], 0
            for at, head, block in salvaged(batch.column("content")[i].as_py()):
                if not isinstance(head, dict):
                    continue  # a gap
                kind = head.get("warc-type", "")
                payload = None if kind == "revisit" else _payload(block)
                if payload is not None:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                else:
                    size, digest = int(head.get("x-payload-length") or 0), head.get("warc-payload-digest", "").partition(":")[2]
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                rows.append((name, at, int(page) if page else None, head.get("warc-target-uri"), size, digest, kind, int(refers) if refers else None, payload if with_payload else None))
                held += 500 + len(payload or b"") * with_payload
                if held > 4 << 20:
                    yield record_batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield record_batch(rows, schema)


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            yield record_batch([(name, *g) for g in salvaged(data.as_py()) if not isinstance(g[1], dict)], arrow_schema(GAP))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of a folder of archives that pass all checks; payload is null for revisits, or if not asked for."""
    return _files(spark, path).mapInArrow(partial(_read, with_payload=with_payload), RECORD)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The byte ranges that the reader left out, with the reason."""
    return _files(spark, path).mapInArrow(_gaps, GAP)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN strlen(p.html) >= {MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.html) >= {MIN_REVISIT} AND page_id > first THEN first END AS refers_to
FROM p JOIN g ON p.html = g.html
"""
