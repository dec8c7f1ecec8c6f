"""Near-duplicates: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

1. Each text's set of word shingles is hashed; its ``KEPT`` least hashes are its sketch. Equal sets make
   one class, whose least doc_id stands for it.
2. Inverted lists of the ``K`` least retained values bring classes together. Of a list of at most ``LISTS[0]`` classes all pairs
   are tried in the task that holds it, and as many kept as connect what passes. Of a longer one each class
   is tried against the list's least, which ties large groups of near copies together. A pair passes if sizes allow
   the similarity and the union's sketch estimates enough in common (``ENOUGH``).
3. What passed makes groups. A long list whose classes all lie in one group is done. Of the others, classes of
   different groups may still be alike. Two sets of similarity 0.8 share 4 of 16 retained values or more but for 2 cases in 10 million,
   and pass a sketch of 32 but for 2 in 10 million. So classes with fewer values in such lists are done, and with a class's values from the shortest list to the longest,
   the first that two such classes share is none of the last three of either: each class stays in the lists of the others only. Of a list then of at most ``DIRECT`` classes
   all pairs of different groups are tried. Classes of longer ones have their values, from the first of such a list on, refined by a second, and where a list is still longer than
   ``LISTS[1]`` by a third; pairs and triples are those that any four values hold one of (``PAIRS``, ``THIRDS``): about a third of all pairs and two fifths of all triples,
   so about 40 pairs a class at most as a rule. Refined lists within one group are done, and of all others all pairs of different groups are tried, in
   ranges of set size and blocks of ``LISTS[2]`` by as many where they are longer. No list is left out.
4. All pairs of a group are compared on the full sets, so links are exact. A group of over ``CLUSTER`` classes is cut into
   blocks of about as many; each block is compared within itself and with about ``HEADS`` classes of the group that all
   blocks get. Mostly one component then holds nearly all; the classes outside the largest component are
   compared with one another and with all of it, block by block.

Defined results: null texts and texts without words have the empty set, are linked with nothing
and kept; a text with fewer words than a shingle is one shingle; a null doc_id is never linked, has a null component and is kept;
rows that share a doc_id are one node; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, materialize, mix64, packed, table, vocabulary, words
from brindle.llm.components import connected, contracted

WIDTH, PERCENT = 2, 80
#: Retained values in all and those that make lists; classes of a block, and of a group that all its blocks get.
KEPT, K, CLUSTER, HEADS = 32, 16, 400, 8
#: Values that a union's sketch of so many holds of both, at least, for a pair to pass.
ENOUGH = {16: 4, 32: 13}
#: Most classes of a list of which all pairs are tried at once, by number of values.
LISTS = (32, 2048, 4096)
#: Most classes of a list of one value of which all pairs are tried once groups are known; refining it makes more rows than that costs.
DIRECT = 512
#: Most group members that are broadcast (about 60 bytes each), and most sketches (about 160); salts of a join that isn't broadcast.
SMALL, SKETCHES, SALTS = 200_000, 30_000, 16
#: Of ``hot``: pairs of values alike modulo 3, and the third values for a pair (x, y): greater and alike, or the next residue.
#: Any four values hold such a pair, as three residues are fewer than four; and such a triple, as three are alike or two residues that follow each other hold two and one.
PAIRS = "flatten(transform(sequence(0, size(hot) - 2), i -> transform(filter(slice(hot, i + 2, size(hot)), y -> pmod(y, 3) = pmod(hot[i], 3)), y -> struct(hot[i] as x, y as y))))"
THIRDS = "filter(hot, z -> if(pmod(z, 3) = pmod(x, 3), z > y, pmod(z, 3) = pmod(pmod(x, 3) + 1, 3)))"
_SIGN = np.uint64(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Columns of the incidence matrix that are multiplied at once, and rows of the product.
COLUMNS, STRIP = 1024, 256


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles, in an order that holds for signed numbers too."""
    flat, offsets = words(pc.ascii_lower(texts.fill_null("")))
    if not len(flat):
        return [np.zeros(0, np.int64)] * len(texts)
    code, vocab = vocabulary(flat)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.to_pylist()), np.uint64, len(vocab))[code]
    acc = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        acc = mix64(acc * _STEP + h[i : len(h) - width + 1 + i]) if len(acc) else acc
    acc = (acc ^ _SIGN).view(np.int64)
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            found.append(np.unique(acc[a : b - width + 1]))
        elif b > a:
            one = np.uint64(xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a))
            found.append(np.array([one ^ _SIGN]).view(np.int64))
        else:
            found.append(np.zeros(0, np.int64))
    return found


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketched(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = arrow_schema("doc_id long, n long, digest binary, sketch array<long>")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), width)
            ends = np.cumsum([min(len(s), KEPT) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate([s[:KEPT] for s in sets])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary()), lists.cast(schema.field("sketch").type)], schema=schema)

    return sketch


def estimates(sketches: list[np.ndarray], pairs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, the values of the union's sketch that both sorted sketches hold, and the size of the union's sketch."""
    pad = np.iinfo(np.int64).max
    grid = np.full((len(sketches), k), pad)
    for row, values in zip(grid, sketches, strict=True):
        row[: len(values)] = values
    common, size = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for at in range(0, len(pairs), 1 << 16):
        some = pairs[at : at + (1 << 16)]
        union = np.sort(np.concatenate([grid[some[:, 0]], grid[some[:, 1]]], axis=1), axis=1)
        again = np.zeros(union.shape, bool)
        again[:, 1:] = union[:, 1:] == union[:, :-1]
        first = (np.cumsum(~again, axis=1) <= k) & (union != pad)
        common[at : at + len(some)] = (first & again).sum(1)
        size[at : at + len(some)] = (first & ~again).sum(1)
    return common, size


def listed(sizes: np.ndarray, sketches: list[np.ndarray], groups: np.ndarray, percent: int, k: int) -> list[tuple[int, int]]:
    """Pairs of a list between different groups that pass, as many as span what they connect; ``k`` values of each sketch count."""
    m = len(sizes)
    if m == 2:
        small, large, a, b = *sorted(sizes.tolist()), *sketches
        possible = groups[0] != groups[1] and 100 * small >= percent * large and k * len(set(a.tolist()).intersection(b.tolist())) >= ENOUGH[k] * max(len(a), len(b))
        if not possible:
            return []
        common, union = estimates(sketches, np.array([[0, 1]]), k)
        return [(0, 1)] if k * common[0] >= ENOUGH[k] * union[0] else []
    values, inverse, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), np.fromiter(map(len, sketches), np.int64, m))
    shared = times[inverse] > 1
    column, owner = (np.cumsum(times > 1) - 1)[inverse[shared]], owner[shared]
    width, many = int((times > 1).sum()), np.fromiter(map(len, sketches), np.int64, m)
    both, pairs = np.zeros((m, m), np.uint8), []
    for at in range(0, width, COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        x = np.zeros((m, min(COLUMNS, width - at)), np.float32)
        x[owner[some], column[some] - at] = 1
        for top in range(0, m, STRIP):
            both[top : top + STRIP] += (x[top : top + STRIP] @ x.T).astype(np.uint8)
    for top in range(0, m, STRIP):
        rows = slice(top, min(top + STRIP, m))
        # the union's sketch is as long as the longer one at least
        possible = k * both[rows].astype(np.int16) >= ENOUGH[k] * np.maximum(many[rows, None], many[None, :])
        possible &= (groups[rows, None] != groups[None, :]) & (100 * np.minimum(sizes[rows, None], sizes[None, :]) >= percent * np.maximum(sizes[rows, None], sizes[None, :]))
        pairs.append(np.argwhere(np.triu(possible, top + 1)) + [top, 0])
    pairs = np.concatenate(pairs)
    common, union = estimates(sketches, pairs, k)
    parent = np.unique(groups, return_index=True, return_inverse=True)
    parent = parent[1][parent[2]].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, j in pairs[k * common >= ENOUGH[k] * union].tolist():
        if (a := root(i)) != (b := root(j)):
            parent[max(a, b)] = min(a, b)
            found.append((i, j))
    return found


def _lists(percent: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by ``key`` to the pairs of each key's list."""
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not rest.num_rows:
                continue
            key = rest.column("key").to_numpy()
            cuts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            stop = int(cuts[-1]) if batch is not None else len(key)
            cuts = cuts.tolist() if batch is not None else [*cuts.tolist(), len(key)]
            if stop:
                cid, n, label = (rest.column(c).to_numpy() for c in ("cid", "n", "label"))
                lists = rest.column("sketch").combine_chunks()
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                links = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b - a > 1:
                        links += [(cid[a + i], cid[a + j]) for i, j in listed(n[a:b], [flat[ends[x] : ends[x + 1]] for x in range(a, b)], label[a:b], percent, k)]
                if links:
                    both = np.array(links)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=out)
                rest = rest.slice(stop).combine_chunks()

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose ``key`` classes of two groups have at least, with the number of classes as ``many`` and the least."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("cid").alias("least"), F.min("label").alias("low"), F.max("label").alias("high"))
    counts = materialize(counts.where("low != high").select("key", "many", "least"), f"{name}-lists")
    return materialize(rows.join(counts, "key"), name)


def _sketched_lists(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, many, cid, n, label) with sketches; a class is joined once, with all its lists, which a sketch's pairs and triples bound."""
    own = lists.groupBy("cid").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list(F.struct("key", "many")).alias("lists"))
    rows = own.join(classes.select("cid", "sketch"), "cid").select("cid", "n", "label", "sketch", F.explode("lists").alias("l"))
    return rows.select("l.key", "l.many", "cid", "n", "label", "sketch")


def _tried(rows: DataFrame, percent: int, k: int) -> DataFrame:
    """Passing pairs of lists (key, cid, n, label, sketch)."""
    # by number, since lists cost far more than their bytes tell
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "cid").select("key", "cid", "n", "label", "sketch").mapInArrow(_lists(percent, k), "a long, b long")


def _blocked(lists: DataFrame, percent: int) -> DataFrame:
    """(key, cid, n, label, sketch); lists over ``LISTS[1]`` are cut into ranges of set size and, by ``LISTS[2]``, into pairs of blocks."""
    # sizes that allow the similarity are at most one step apart; ranges are of four steps, and a class of the last step is in the next range too
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    blocks = F.ceil(F.col("many") / LISTS[2]).cast("int")
    rows = lists.withColumn("size", size).withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64(F.lit(9), "cid"), F.col("nb")).cast("int"))
    parts = f"if(many <= {LISTS[1]}, array(key), flatten(transform(if(size % 4 = 3, array(size div 4, size div 4 + 1), array(size div 4)), r -> transform(sequence(0, nb - 1), k -> xxhash64(key, r, least(k, blk), greatest(k, blk))))))"
    return rows.select(F.explode(F.expr(parts)).alias("key"), "cid", "n", "label", "sketch")


def _with_least(long: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Passing pairs of a long list's classes with its least."""
    heads = materialize(long.select("least").distinct().join(classes, F.col("least") == F.col("cid")).select("least", F.col("n").alias("m"), F.col("sketch").alias("other")), "heads")
    tried = long.where("cid != least").groupBy("cid", "n").agg(F.collect_set("least").alias("heads")).join(classes.select("cid", "sketch"), "cid")
    tried = tried.select("cid", "n", "sketch", F.explode("heads").alias("least"))
    if heads.count() <= SKETCHES:
        both = tried.join(F.broadcast(heads), "least")
    else:  # a class may be the least of very many
        salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = tried.withColumn("salt", F.pmod(F.hash("cid"), F.lit(SALTS))).join(salted, ["least", "salt"])
    both = both.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).withColumn("u", F.slice(F.array_sort(F.array_union("sketch", "other")), 1, KEPT))
    shared = F.size(F.array_intersect(F.array_intersect("sketch", "other"), "u"))
    return both.where(KEPT * shared >= ENOUGH[KEPT] * F.size("u")).select(F.col("least").alias("a"), F.col("cid").alias("b"))


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of groups of classes between which no two sets are alike."""
    rows = classes.select(F.explode(F.slice("sketch", 1, K)).alias("key"), "cid", "n", F.col("cid").alias("label"))
    one = _counted(rows, "postings")
    long = one.where(f"many > {LISTS[0]}")
    short = one.where(f"many <= {LISTS[0]}").join(classes.select("cid", F.slice("sketch", 1, K).alias("sketch")), "cid")
    first = _tried(short, percent, K).union(contracted(_with_least(long, classes, percent)))
    groups = materialize(connected(first), "groups")
    left = long.select("key", "cid", "n").join(groups, F.col("cid") == F.col("node"), "left").select("key", "cid", "n", F.coalesce("label", "cid").alias("label"))
    mixed = _counted(left, "mixed").groupBy("cid", "n", "label").agg(F.sort_array(F.collect_set(F.struct("many", "key"))).alias("hot")).where(f"size(hot) >= {ENOUGH[K]}")
    mixed = materialize(mixed.select("cid", "n", "label", F.expr("transform(hot, x -> x.key)").alias("hot")), "hot")
    # the first value that two classes share has ENOUGH - 1 after it in both
    single = _counted(mixed.select("cid", "n", "label", F.explode(F.expr(f"slice(hot, 1, size(hot) - {ENOUGH[K] - 1})")).alias("key")), "postings1")
    far = single.where(f"many > {DIRECT}").groupBy("cid").agg(F.collect_set("key").alias("far"))
    hot = "slice(hot, array_min(transform(far, x -> cast(array_position(hot, x) as int))), size(hot))"
    mixed = materialize(mixed.join(far, "cid").select("cid", "n", "label", F.sort_array(F.expr(hot)).alias("hot")), "far")
    pairs = mixed.select("cid", "n", "label", F.explode(F.expr(PAIRS)).alias("p"))
    two = _counted(pairs.select("cid", "n", "label", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.xxhash64("p.x", "p.y").alias("key")), "postings2")
    more = two.where(f"many > {LISTS[1]}").select("cid", "n", "label", "x", "y").join(mixed.select("cid", "hot"), "cid").select("cid", "n", "label", "x", "y", F.explode(F.expr(THIRDS)).alias("z"))
    three = _counted(more.select("cid", "n", "label", F.xxhash64("x", "y", "z").alias("key")), "postings3")
    parts = [single.where(f"many <= {DIRECT}"), two.where(f"many <= {LISTS[1]}"), three]
    refined = reduce(DataFrame.union, [x.select("key", "many", "cid", "n", "label") for x in parts])
    later = materialize(_tried(_blocked(_sketched_lists(refined, classes), percent), percent, KEPT).distinct(), "later")
    if later.isEmpty():
        return groups
    return connected(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).union(later))


def spanning(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and of ``right`` that span the components of all such links."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[inverse] > 1
    column = (np.cumsum(times > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        inter += x[left] @ x[right].T
    inter = inter.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    linked = (100 * inter >= percent * union) & (union > 0)
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for r in range(len(left)):
        u = int(left[r])
        # one find for each component that the row touches
        for v in right[linked[r]].tolist():
            if v != u and parent[v] != parent[u] and (a := root(u)) != (b := root(v)):
                parent[max(a, b)] = min(a, b)
                found.append((u, v))
    return found


def _with_sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), width)
            keep = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist(), strict=True)) if _digest(s) == d]
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("cid"), pa.array([sets[i].tobytes() for i in keep], pa.binary()), kept.column("g")], ["cid", "content", "g"])

    return build


def _verified(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, sets, links = None, [], [], [], []

        def close() -> None:
            if len(ids) > 1:
                side = np.array(sides)
                # side 0 is compared within itself and with side 1
                left = np.flatnonzero(side == 0)
                links.extend((ids[u], ids[v]) for u, v in spanning(sets, left, np.arange(len(ids)), percent) if ids[u] != ids[v])

        for batch in batches:
            for key, cid, side, content in zip(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True), batch.column("cid").to_pylist(), batch.column("side").to_pylist(), batch.column("content"), strict=True):
                if key != now:
                    close()
                    now, ids, sides, sets = key, [], [], []
                ids.append(cid)
                sides.append(side)
                sets.append(np.frombuffer(content.as_buffer(), np.int64))
            sets = [s.copy() for s in sets]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
                links.clear()
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return verify


def _compared(base: DataFrame, dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """Links found in the blocks that ``dealt`` (cid, cluster, digest, g: the blocks i, j of a class and its side there) sends its classes to."""
    dealt = materialize(dealt, "nodes")
    nodes = F.broadcast(dealt) if dealt.count() <= SMALL else dealt
    texts = base.join(nodes, F.col("cid") == F.col("doc_id")).select("cid", "digest", "text", F.expr("transform(g, x -> struct(cluster as cluster, x.i as i, x.j as j, x.side as side))").alias("g"))
    block = "array<struct<cluster: bigint, i: int, j: int, side: int>>"
    sets = texts.mapInArrow(_with_sets(width), f"cid bigint, content binary, g {block}")
    spread = sets.select("cid", "content", F.explode("g").alias("g")).select("g.cluster", "g.i", "g.j", "g.side", "cid", "content")
    return spread.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "cid").mapInArrow(_verified(percent), "a long, b long")


def _bounded(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written, and broadcast if they are few."""
    rows = materialize(rows, name)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _linked(base: DataFrame, classes: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of the components of all exact links within groups."""
    large = materialize(groups.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(f"m > {CLUSTER}"), "large")
    some = not large.isEmpty()
    named = groups.select(F.col("node").alias("cid"), F.col("label").alias("cluster")).join(classes.select("cid", "digest"), "cid")
    sized = named.join(_bounded(large.withColumnRenamed("label", "l"), "large"), F.col("cluster") == F.col("l"), "left").drop("l")
    nb = F.coalesce(F.ceil(F.col("m") / CLUSTER), F.lit(1)).cast("int")
    first = sized.withColumn("nb", nb).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")).withColumn("head", (F.col("nb") > 1) & (F.pmod(F.xxhash64(F.lit(5), "cid"), F.col("m")) < HEADS))
    own = "array(struct(blk as i, blk as j, 0 as side))"
    every = "transform(sequence(0, nb - 1), k -> struct(k as i, k as j, if(k = blk, 0, 1) as side))"
    links = materialize(_compared(base, first.select("cid", "cluster", "digest", F.expr(f"if(head, {every}, {own})").alias("g")), width, percent), "links")
    found = connected(links)
    if not some:
        return found
    found = materialize(found, "found")
    in_large = sized.where("m is not null").join(found.withColumnRenamed("label", "part"), F.col("cid") == F.col("node"), "left").select("cid", "cluster", "digest", F.coalesce("part", "cid").alias("part"))
    in_large = materialize(in_large, "in-large")
    parts = in_large.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c"))
    whole = parts.groupBy("cluster").agg(F.max(F.struct("c", (-F.col("part")).alias("p"))).alias("t"), F.sum("c").alias("m")).select(F.col("cluster").alias("l"), (-F.col("t.p")).alias("main"), F.col("t.c").alias("c"), "m").where("c < m")
    whole = materialize(whole, "whole")
    if whole.isEmpty():
        return found
    # main: classes of the largest component, blocks below zero; the rest, blocks from zero
    rest = in_large.join(_bounded(whole, "whole"), F.col("cluster") == F.col("l")).select(
        "cid", "cluster", "digest", (F.col("part") == F.col("main")).alias("main"), F.ceil(F.col("c") / CLUSTER).cast("int").alias("nm"), F.ceil((F.col("m") - F.col("c")) / CLUSTER).cast("int").alias("nr")
    ).withColumn("blk", F.pmod(F.xxhash64("cid"), F.when(F.col("main"), F.col("nm")).otherwise(F.col("nr"))).cast("int"))
    ofmain = "transform(sequence(0, nr - 1), k -> struct(k as i, -1 - blk as j, 1 as side))"
    ofrest = "concat(transform(sequence(0, nm - 1), k -> struct(blk as i, -1 - k as j, 0 as side)), transform(sequence(0, nr - 1), k -> struct(least(k, blk) as i, greatest(k, blk) as j, if(k < blk, 1, 0) as side)))"
    more = materialize(_compared(base, rest.select("cid", "cluster", "digest", F.expr(f"if(main, {ofmain}, {ofrest})").alias("g")), width, percent), "links")
    if more.isEmpty():
        return found
    return connected(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (the component's least)."""
    if percent < PERCENT:
        raise ValueError(f"lists are made for a similarity of {PERCENT} percent and more")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = materialize(base.mapInArrow(_sketched(width), "doc_id long, n long, digest binary, sketch array<long>"), "sketches")
    classes = materialize(drawn.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    groups = materialize(candidates(classes, percent), "clusters")
    merged = _linked(base, classes, groups, width, percent)
    named = materialize(classes.select("digest", "cid").join(merged, F.col("cid") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("label", "cid").alias("component")), "components")
    out = drawn.select("doc_id", "n", "digest").join(named, (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a near duplicate of a smaller id stands for."""
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return packed(docs).join(gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti").select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
