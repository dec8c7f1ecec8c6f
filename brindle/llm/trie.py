"""Conversation prefix trie: families of conversations are merged first, their nodes after that.

Conversations of one base id (``conv_id - conv_id % 20``) share a family. A family's turns meet in one task, sorted by
their place, and are read once, place by place: a conversation is rebuilt from the base's first turns and its own, each of
its prefixes is named by a hash of the prefix before it and the turn, and equal prefixes of the family become one node at
once. A task holds a few places of one family at a time, however long conversations are. Only these family nodes are
shuffled on: they are summed by name into the nodes of the whole trie. Nodes of several families are then told to each of
them, and a second walk from the leaves up sums subtrees within families, a node counting in the family of its smallest
member alone; those sums are added by name.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own; null
role or text is empty; rows without a conv_id belong to no conversation and are left out; an empty table gives an empty
result (no root); further columns are ignored. Prefixes are told apart by 160 bits of a SHA-256 chain.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, materialize, record_batch, table

#: Conversations of a family; places that are copied at most, less one: h is a checksum modulo HEADS.
FAMILY, HEADS = 20, 4
#: Nodes in more than 1 / HEAVY of all family nodes are broadcast, HEAVY of them at most; ids that are joined into one text.
HEAVY, IDS = 4096, 4096
#: Rows of an output batch.
ROWS = 8192

NODES = "family long, key binary, parent binary, depth long, n long, conv long, words long, inner boolean, ends array<long>"
ROOT = hashlib.sha256(b"").digest()[:20]


def named(parent: bytes, role: str, text: str) -> bytes:
    """The name of a prefix: of the prefix before it and its last turn."""
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.sha256(parent + len(r).to_bytes(8, "little") + r + text.encode("utf-8", "surrogatepass")).digest()[:20]


def n_words(text: str) -> int:
    """Words ``[^\\x20\\x09-\\x0D]+``: runs that ASCII blanks end."""
    return len(text.encode("utf-8", "surrogatepass").split())


def heads(conv: int) -> int:
    """How many turns of the base a conversation takes at most."""
    return zlib.crc32(str(conv).encode()) % HEADS


class Family:
    """The nodes of one family, told place by place; what no later place can reach is given out."""

    def __init__(self, family: int):
        self.family = family
        self.at = 0  # the place that is read
        self.base: list[tuple[str, str]] = []  # the base's first turns
        self.first: dict[int, list[tuple[str, str]]] = {}  # turns of every conversation until the base's are known
        self.open: dict[int, list] = {}  # conversation: [name, depth, place of its last turn]
        self.levels: dict[int, dict[bytes, list]] = {0: {ROOT: [None, 0, None, 0, False, []]}}
        self.known = False

    def _visit(self, conv: int, key: bytes, parent: bytes | None, depth: int, text: str) -> None:
        level = self.levels.setdefault(depth, {})
        if (node := level.get(key)) is None:
            node = level[key] = [parent, 0, None, n_words(text), False, []]
        node[1] += 1
        node[2] = conv if node[2] is None else min(node[2], conv)

    def _step(self, conv: int, turn: tuple[str, str]) -> None:
        state = self.open[conv]
        self.levels[state[1]][state[0]][4] = True
        key = named(state[0], *turn)
        state[1] += 1
        self._visit(conv, key, state[0], state[1], turn[1])
        state[0] = key

    def _rebuild(self) -> None:
        """The base's first turns are known: what was kept becomes prefixes."""
        self.known = True
        for conv, turns in self.first.items():
            self.open[conv] = [ROOT, 0, self.at]
            self._visit(conv, ROOT, None, 0, "")
            h = heads(conv)
            for turn in self.base[:h] + turns[h:]:
                self._step(conv, turn)
            self.open[conv][2] = len(turns)
        self.first = {}

    def turn(self, place: int, conv: int, role: str, text: str) -> Iterator[tuple]:
        if place != self.at:
            if self.at == HEADS - 1:
                self._rebuild()
            if self.known:
                self._close(self.at)
                yield from self._given(self.at - 2 * HEADS)
            self.at = place
        if not self.known:
            self.first.setdefault(conv, []).append((role, text))
            if conv == self.family:
                self.base.append((role, text))
        else:
            self._step(conv, (role, text))
            self.open[conv][2] = place

    def _close(self, place: int) -> None:
        """Conversations without a turn at this place end where they are."""
        for conv in [c for c, s in self.open.items() if s[2] < place]:
            key, depth, _ = self.open.pop(conv)
            self.levels[depth][key][5].append(conv)

    def _given(self, depth: int) -> Iterator[tuple]:
        for d in sorted(d for d in self.levels if d <= depth):
            for key, (parent, n, conv, words, inner, ends) in self.levels.pop(d).items():
                if n:
                    yield self.family, key, parent, d, n, conv, words, inner, sorted(ends)

    def rest(self) -> Iterator[tuple]:
        if not self.known:
            self._rebuild()
        self._close(1 << 62)
        yield from self._given(1 << 62)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family and place; nodes of each family."""
    schema = arrow_schema(NODES)
    now, rows = None, []
    for batch in chunks(batches):
        for family, place, conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("family", "place", "conv_id", "role", "text")), strict=True):
            if now is None or now.family != family:
                if now is not None:
                    rows.extend(now.rest())
                now = Family(family)
            rows.extend(now.turn(place, conv, role, text))
            if len(rows) >= ROWS:
                yield record_batch(rows, schema)
                rows = []
    if now is not None:
        rows.extend(now.rest())
    if rows:
        yield record_batch(rows, schema)


def family_of(conv: str) -> F.Column:
    return F.col(conv) - F.col(conv) % FAMILY


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie: name, parent's name, depth, members there, the least of them, words of the last text, whether it has children there, members that end there."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    own = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    dealt = turns.withColumn("family", family_of("conv_id")).repartition("family").withColumn("place", F.row_number().over(own).cast("long"))
    return dealt.select("family", "place", "conv_id", "role", "text").sortWithinPartitions("family", "place", "conv_id").mapInArrow(_families, NODES)


def _told(nodes: DataFrame) -> DataFrame:
    """Family nodes with what the whole trie knows of them: members, the least of them, whether it has children.

    A node of one family is known there. Of the others, those of more than 1 / HEAVY of all rows are HEAVY at most and are
    broadcast, so that no task joins all rows of one node.
    """
    total = nodes.count()
    shared = nodes.groupBy("key").agg(F.sum("n").alias("all_n"), F.min("conv").alias("all_conv"), F.max("inner").alias("all_inner"), F.count("*").alias("families")).where("families > 1")
    most = max(1, total // HEAVY)
    shared = materialize(shared, "trie-shared")
    heavy, light = (shared.where(c).drop("families") for c in (F.col("families") > most, F.col("families") <= most))
    rows = nodes.drop("ends")
    met = rows.join(F.broadcast(heavy), "key")
    others = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key", "left")
    known = met.unionByName(others)
    return known.select(
        "family", "key", "parent", "depth", "words", F.coalesce("all_n", "n").alias("n"), F.coalesce("all_conv", "conv").alias("conv"), F.coalesce("all_inner", "inner").alias("inner")
    ).withColumn("owned", family_of("conv") == F.col("family"))


SUMS = "key binary, depth long, n long, conv long, parent_conv long, children long, leaves long, saved long"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, deepest first; each node's sums over its subtree, of what its family owns."""
    schema = arrow_schema(SUMS)
    family, depth, rows = None, None, []
    below: dict[bytes, list[int]] = {}  # of the depth that is read: children, leaves and saved of what hangs on a node
    up: dict[bytes, list[int]] = {}  # of the depth above
    waiting: dict[bytes, list[tuple]] = {}  # nodes whose parent comes next, by the parent's name
    told: dict[bytes, list[tuple]] = {}
    for batch in batches:
        for f, key, parent, d, words, n, conv, inner, owned in zip(*(batch.column(c).to_pylist() for c in ("family", "key", "parent", "depth", "words", "n", "conv", "inner", "owned")), strict=True):
            if f != family or d != depth:
                below, up = up if f == family else {}, {}
                told, waiting = waiting if f == family else {}, {}
                family, depth = f, d
            children, leaves, saved = below.get(key, (0, 0, 0))
            rows += [(*node, conv, *sums) for node, sums in told.get(key, ())]
            if owned:
                leaves += not inner
                saved += (n - 1) * words
            node, sums = (key, d, n, conv), (children, leaves, saved)
            if parent is None:
                rows.append((*node, None, *sums))
            else:
                waiting.setdefault(parent, []).append((node, sums))
                total = up.setdefault(parent, [0, 0, 0])
                total[0] += owned
                total[1] += leaves
                total[2] += saved
        if len(rows) >= ROWS:
            yield record_batch(rows, schema)
            rows = []
    if rows:
        yield record_batch(rows, schema)


ENDS = "key binary, ends_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name and range of ids; the digest of each name's ids, joined by commas."""
    schema = arrow_schema(ENDS)
    now, sha, rows = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == now:
                sha.update(b"," + ids.encode())
            else:
                if now is not None:
                    rows.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
        if len(rows) >= ROWS:
            yield record_batch(rows, schema)
            rows = []
    if now is not None:
        rows.append((now, sha.hexdigest()))
    if rows:
        yield record_batch(rows, schema)


def end_digests(nodes: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node: ranges of ids are joined into one text each before a node's ranges meet."""
    ids = nodes.select("key", F.explode("ends").alias("conv")).groupBy("key", F.floor(F.col("conv") / IDS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return ids.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(_digests, ENDS)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    nodes = materialize(family_nodes(conversations), "trie-nodes")
    sums = _told(nodes).repartition("family").sortWithinPartitions("family", F.col("depth").desc()).mapInArrow(_subtrees, SUMS)
    whole = sums.groupBy("key").agg(
        F.first("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_conv").alias("parent_conv_id"), F.first("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    return whole.join(end_digests(nodes), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a short text, bit by bit: a byte is mixed in (x >= 0), then eight steps follow (x = -1).
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten([list_concat([ord(ch)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1]) FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"

ORACLE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text FROM built),
paths AS (
  SELECT conv_id, depth, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
    len([w FOR w IN regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') IF w <> '']) AS words FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words FROM paths GROUP BY 1, 2),
lasts AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY 1),
ends AS (SELECT key, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN lasts USING (conv_id, depth) GROUP BY 1, 2),
edges AS (SELECT DISTINCT p.key, p.depth, c.key AS child FROM paths p JOIN paths c ON c.conv_id = p.conv_id AND c.depth = p.depth + 1),
kids AS (SELECT key, depth, count(*) AS n_children FROM edges GROUP BY 1, 2),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, depth)),
subs AS (SELECT DISTINCT a.key, a.depth, b.key AS under, b.depth AS deep FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT s.key, s.depth, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, CAST(sum((v.n - 1) * v.words) AS BIGINT) AS saved_tokens
  FROM subs s JOIN valued v ON v.key = s.under AND v.depth = s.deep GROUP BY 1, 2),
up AS (SELECT DISTINCT c.key, c.depth, p.key AS parent FROM paths c JOIN paths p ON c.conv_id = p.conv_id AND p.depth = c.depth - 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM valued v JOIN sums s USING (key, depth) LEFT JOIN ends e USING (key, depth) LEFT JOIN up u USING (key, depth) LEFT JOIN nodes p ON p.key = u.parent AND p.depth = v.depth - 1
"""
