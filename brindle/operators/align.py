"""Alignment of axes by name: joins, unions, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import names as N


def bulk_long(wide: DataFrame, name: str = "name") -> DataFrame:
    """A dense table with one name column as (name, sample, value)."""
    samples = [c for c in wide.columns if c != name]
    return wide.unpivot([name], samples, "sample", "value")


def orientation(row_names: DataFrame, column_names: DataFrame, model: DataFrame) -> DataFrame:
    """Which axis of a table is the model's: 10 times as many matches win; otherwise null (neither, or both).

    Each input has one ``name`` column; the result has ``row_hits, column_hits, feature_axis``.
    """
    keys = model.select(N.match_key("name").alias("key")).distinct()
    hits = lambda d: d.select(N.match_key("name").alias("key")).join(keys, "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    both = hits(row_names).withColumnRenamed("n", "row_hits").crossJoin(hits(column_names).withColumnRenamed("n", "column_hits"))
    r, c = F.col("row_hits"), F.col("column_hits")
    return both.withColumn("feature_axis", F.when((r > 0) & (r >= 10 * c), "rows").when((c > 0) & (c >= 10 * r), "columns"))


def align_bulk(bulk: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, sample, value) over the whole feature axis: many to one summed, unmatched 0.

    A key that several features share belongs to the first of them. Fails at run time on negative values.
    """
    first = features.groupBy(N.match_key("name").alias("key")).agg(F.min("feature_id").alias("feature_id"))
    value = F.when(F.col("value") < 0, F.raise_error(F.lit("a bulk value is negative"))).otherwise(F.col("value"))
    got = bulk.select(N.match_key("name").alias("key"), "sample", value.alias("value")).join(first, "key").groupBy("feature_id", "sample").agg(F.sum("value").alias("value"))
    axis = features.select("feature_id").join(bulk.select("sample").distinct(), how="cross")
    return axis.join(got, ["feature_id", "sample"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def coverage(query: DataFrame, model: DataFrame) -> DataFrame:
    """One row: how many query names (``name``) reach a model name, of how many, and the share."""
    keys = model.select(N.match_key("name").alias("key")).distinct().withColumn("hit", F.lit(1))
    return query.select(N.match_key("name").alias("key")).join(keys, "key", "left").agg(F.count("hit").alias("mapped"), F.count(F.lit(1)).alias("total")).withColumn("share", F.col("mapped") / F.col("total"))


def cell_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) by exact name; by bare barcode, where unique on both sides, if exact finds under 90 % and barcodes find more.

    Inputs have ``id`` and ``name``.
    """
    exact = a.select(F.col("id").alias("a_id"), "name").join(b.select(F.col("id").alias("b_id"), "name"), "name").select("a_id", "b_id")
    single = lambda d, c: d.groupBy(N.barcode("name").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(c)).where("n = 1").drop("n")
    bare = single(a, "a_id").join(single(b, "b_id"), "code").select("a_id", "b_id")
    tally = a.agg(F.count(F.lit(1)).alias("cells")).crossJoin(exact.agg(F.count(F.lit(1)).alias("e"))).crossJoin(bare.agg(F.count(F.lit(1)).alias("c")))
    use_bare = (F.col("e") * 10 < F.col("cells") * 9) & (F.col("c") > F.col("e"))
    choice = F.broadcast(tally.select(use_bare.alias("use_bare")))
    both = exact.withColumn("bare", F.lit(False)).unionByName(bare.withColumn("bare", F.lit(True)))
    return both.crossJoin(choice).where(F.col("bare") == F.col("use_bare")).select("a_id", "b_id")


def tolerant_align(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` (pos, name) with ``right_pos`` of the equal name, null where there is none; a repeated right name that would match fails."""
    names = right.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("right_pos"))
    at = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("name stands twice: "), F.col("name")))).otherwise(F.col("right_pos"))
    return left.join(names, "name", "left").select("pos", "name", at.alias("right_pos"))


def remap_features(query: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, feature_id): exact key, the last model feature of a key winning; else the flexible key, the first winning; null if neither."""
    exact = model.groupBy(N.match_key("name").alias("key")).agg(F.max("feature_id").alias("exact_id"))
    loose = model.where(~N.is_locus("name")).groupBy(N.flexible_key("name").alias("loose")).agg(F.min("feature_id").alias("loose_id"))
    q = query.select(F.col("feature_id").alias("query_id"), N.match_key("name").alias("key"), F.when(~N.is_locus("name"), N.flexible_key("name")).alias("loose"))
    return q.join(exact, "key", "left").join(loose, "loose", "left").select("query_id", F.coalesce("exact_id", "loose_id").alias("feature_id"))


def apply_remap(counts: DataFrame, remap: DataFrame) -> DataFrame:
    """Counts on the model's axis: counts of query features that meet in one are summed."""
    return counts.withColumnRenamed("feature_id", "query_id").join(remap.where("feature_id is not null"), "query_id").groupBy("cell_id", "feature_id").agg(F.sum("value").alias("value"))


def strict_join(cells: DataFrame, parent: DataFrame, key: str, value: str) -> DataFrame:
    """``cells`` with the parent's value; a cell that the parent lacks fails."""
    got = cells.join(parent.select(key, value, F.lit(1).alias("__hit")), key, "left")
    return got.withColumn(value, F.when(F.col("__hit").isNull(), F.raise_error(F.lit("a cell isn't in the parent"))).otherwise(F.col(value))).drop("__hit")


def union_axis(known: DataFrame, new: DataFrame) -> DataFrame:
    """(name, pos): names of ``known`` keep their place, others follow in order of name."""
    from pyspark.sql import Window

    extra = new.select("name").distinct().join(known.select("name"), "name", "left_anti")
    top = known.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("top"))
    numbered = extra.withColumn("r", F.row_number().over(Window.orderBy("name"))).crossJoin(F.broadcast(top)).select("name", (F.col("top") + F.col("r") - 1).alias("pos"))
    return known.select("name", "pos").unionByName(numbered)


def namespaced(counts: DataFrame, modality: str, group: Column | None = None) -> DataFrame:
    """Feature names ``name/modality`` and barcodes ``barcode@group``."""
    out = counts.withColumn("feature", F.concat("feature", F.lit(f"/{modality}")))
    return out if group is None else out.withColumn("cell", N.tagged("cell", group))


def modality_vote(query: DataFrame, trained: DataFrame) -> DataFrame:
    """Each query modality's trained block: that with most shared features, the first by name of equals.

    Inputs have ``modality, name``; ``shared`` and ``disputed`` (another claims the same block) tell how sure it is.
    """
    from pyspark.sql import Window

    shared = query.select(F.col("modality").alias("query"), "name").join(trained.select(F.col("modality").alias("block"), "name"), "name").groupBy("query", "block").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "block"))).where("r = 1").drop("r")
    return best.withColumn("disputed", F.count(F.lit(1)).over(Window.partitionBy("block")) > 1)


def batch_delta(cells: DataFrame, delta: DataFrame) -> DataFrame:
    """(cell_id, feature_id, delta): the batch's ratio of every trained feature, 1 for unknown batches."""
    features = delta.select("feature_id").distinct()
    return cells.select("cell_id", "batch").crossJoin(features).join(delta, ["batch", "feature_id"], "left").select("cell_id", "feature_id", F.coalesce("delta", F.lit(1.0)).alias("delta"))


def windows(regions: DataFrame, width: int) -> DataFrame:
    """Regions ``chr, start, end`` on fixed windows, one row each, named ``chr:start-end``; width 0 keeps the region."""
    if width <= 0:
        return regions.withColumn("window", F.concat_ws("", "chr", F.lit(":"), "start", F.lit("-"), "end"))
    low, high = F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width)
    return regions.withColumn("w", F.explode(F.sequence(low, high))).withColumn("window", F.concat_ws("", "chr", F.lit(":"), F.col("w") * width, F.lit("-"), (F.col("w") + 1) * width)).drop("w")


def present_hierarchy(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Hierarchy edges (child, parent) whose ends are both among the terms, in canonical spelling."""
    t = terms.select(N.curie("term").alias("term")).distinct()
    e = edges.select(N.curie("child").alias("child"), N.curie("parent").alias("parent")).where("child != parent").distinct()
    return e.join(t.withColumnRenamed("term", "child"), "child", "left_semi").join(t.withColumnRenamed("term", "parent"), "parent", "left_semi").select("child", "parent")


def dense_labels(labels: DataFrame) -> DataFrame:
    """(cell_id, label) without unassigned cells, ids renumbered from 0 in their order."""
    ids = labels.where("label is not null").select("label").distinct()
    from pyspark.sql import Window

    new = ids.withColumn("dense", F.row_number().over(Window.orderBy("label")) - 1)
    return labels.join(new, "label").select("cell_id", F.col("dense").alias("label"))


def refuse_recorded(new: DataFrame, recorded: DataFrame, key: str = "path") -> DataFrame:
    """The new inputs that aren't recorded yet, path spelling aside."""
    canon = lambda c: F.regexp_replace(F.regexp_replace(c, r"/\./", "/"), r"//+", "/")
    return new.withColumn("__k", canon(F.col(key))).join(recorded.select(canon(F.col(key)).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def carry_rows(own: DataFrame, carried: DataFrame, key: str = "name") -> DataFrame:
    """A run's own rows, then carried rows that it lacks."""
    return own.withColumn("carried", F.lit(False)).unionByName(carried.join(own.select(key), key, "left_anti").withColumn("carried", F.lit(True)))
