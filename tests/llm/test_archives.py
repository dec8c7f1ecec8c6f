"""Archives bounded by bytes, read a member at a time."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

from brindle.llm import warc


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Pages of a third of a megabyte that don't compress, and one larger than an archive."""
    rnd = random.Random(1)
    page = lambda n: "".join(chr(rnd.randrange(0x21, 0x7F)) for _ in range(n))
    rows = [(i, "u", page(300_000)) for i in range(12)] + [(99, "u", page(2_500_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), limit=1 << 20)
    sizes = [p.stat().st_size for p in Path(tmp_path / "w").rglob("*.txt")]
    assert len(sizes) > 4 and sorted(sizes)[-2] < 1.05 * (1 << 20)
    got = {r.page_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / "w"), with_payload=False).collect()}
    assert got == {i: len(h) for i, _, h in rows} and warc.quarantined(spark, str(tmp_path / "w")).count() == 0


def test_large_pages_are_inflated_one_at_a_time():
    """Forty pages of three megabytes: a reader that lets go of each holds a few of them at most."""
    body = b"<p>words and words</p>\n" * 130_000
    data = b"".join(warc._member(warc.make_record(i, "u", b"%d" % i + body)) for i in range(40))
    tracemalloc.start()
    n = total = 0
    for at, head, block in warc.salvaged(data):
        assert isinstance(head, dict), at
        n, total = n + 1, total + len(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40 and total > 110 << 20 and peak < 40 << 20


def test_gaps_come_in_order_with_the_records():
    members = [warc._member(warc.make_record(i, "u", b"payload %d " % i * 40)) for i in range(6)]
    data = bytearray(b"".join(members))
    at = sum(map(len, members[:2])) + 20
    data[at : at + 30] = b"\0" * 30
    seen = list(warc.salvaged(bytes(data)))
    starts = [x[0] for x in seen]
    assert starts == sorted(starts) and sum(isinstance(x[1], dict) for x in seen) == 5
    records, gaps = warc.salvage(bytes(data))
    assert len(records) == 5 and len(gaps) == 1 and gaps[0][0] == sum(map(len, members[:2]))
