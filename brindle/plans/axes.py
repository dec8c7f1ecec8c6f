"""Queries: inputs, alignment, filters, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.operators import align, filters, rank
from brindle.plans.base import Registry, sql
from brindle.sources import counts as S

R = Registry()


def _named_counts(spark: SparkSession, d: str, status: str) -> DataFrame:
    o = S.table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
    l = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.concat(F.lit("c"), "o_custkey").alias("cell_name"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").cast("long").alias("value"))


_STACK = "SELECT concat('c', o_custkey, '@', o_orderstatus) AS cell_name, o_orderstatus AS batch, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_custkey, o_orderstatus, l_partkey"


@R.add("s1_stack_inputs", sql("SELECT batch, count(DISTINCT cell_name) AS cells, count(DISTINCT feature_id) AS features, CAST(sum(value) AS BIGINT) AS total FROM s GROUP BY batch", s=_STACK))
def stack_inputs(spark: SparkSession, d: str) -> DataFrame:
    s = S.stack({x: _named_counts(spark, d, x) for x in ("F", "O", "P")})
    return s.groupBy("batch").agg(F.count_distinct("cell_name").alias("cells"), F.count_distinct("feature_id").alias("features"), F.sum("value").alias("total"))


@R.add(
    "s2_stack_modalities",
    sql(
        "SELECT cell_id, modality, CAST(sum(value) AS BIGINT) AS total FROM m WHERE cell_id IN (SELECT cell_id FROM m GROUP BY cell_id HAVING count(DISTINCT modality) = 2) GROUP BY 1, 2",
        m="SELECT o_custkey AS cell_id, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS modality, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
)
def stack_modalities(spark: SparkSession, d: str) -> DataFrame:
    l = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = lambda c: l.where(c).select(F.col("o_custkey").alias("cell_id"), F.col("l_quantity").cast("long").alias("value"))
    s = S.stack_modalities([part("l_returnflag = 'R'"), part("l_returnflag != 'R'")], ["returned", "kept"])
    return s.groupBy("cell_id", "modality").agg(F.sum("value").alias("total"))


@R.add("s4_one_batch", sql("SELECT 'all' AS batch, count(*) AS cells FROM cells", "cells"))
def one_batch(spark: SparkSession, d: str) -> DataFrame:
    return S.one_batch(S.customer_cells(spark, d)).groupBy("batch").agg(F.count(F.lit(1)).alias("cells"))


_SPELLED = "concat('ENSG', lpad(CAST(p_partkey AS VARCHAR), 5, '0'), '_P', p_partkey)"


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """Parts under their long spelling."""
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("_P"), "p_partkey").alias("name"))


@R.add("s7_orientation", "SELECT (SELECT count(*) FROM part) AS row_hits, CAST(0 AS BIGINT) AS column_hits, 'rows' AS feature_axis")
def orientation(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    columns = S.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return align.orientation(rows, columns, _spelled(spark, d))


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    """Parts by supplier, each part under the short name."""
    return S.table(spark, d, "lineitem").groupBy(F.concat(F.lit("P"), "l_partkey").alias("name"), F.col("l_suppkey").alias("sample")).agg(F.sum("l_quantity").cast("double").alias("value"))


@R.add(
    "s8_align_bulk",
    sql(
        "SELECT s.sample, count(*) AS features, count(*) FILTER (v.value IS NULL) AS filled, CAST(sum(coalesce(v.value, 0)) AS BIGINT) AS total FROM (SELECT DISTINCT l_suppkey AS sample FROM lineitem) s CROSS JOIN part LEFT JOIN b v ON v.feature_id = p_partkey AND v.sample = s.sample GROUP BY s.sample",
        b="SELECT l_partkey AS feature_id, l_suppkey AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2",
    ),
)
def align_bulk(spark: SparkSession, d: str) -> DataFrame:
    a = align.align_bulk(_bulk(spark, d), _spelled(spark, d))
    return a.groupBy("sample").agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("value") == 0).alias("filled"), F.sum("value").cast("long").alias("total"))


@R.add("s8_coverage", "SELECT count(*) AS mapped, count(*) AS total, CAST(1.0 AS DOUBLE) AS share FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def bulk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return align.coverage(_bulk(spark, d).select("name").distinct(), _spelled(spark, d))


@R.add("s14_clone_strata", "SELECT stratum, count(*) AS cells FROM (SELECT CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 0 END AS stratum FROM customer) GROUP BY 1")
def clone_strata(spark: SparkSession, d: str) -> DataFrame:
    cells = S.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), "c_acctbal")
    clones = cells.where("c_acctbal > 0").select("cell_id", F.when(F.col("c_acctbal") > 5000, 1).otherwise(2).alias("stratum"))
    return cells.join(clones, "cell_id", "left").select("cell_id", F.coalesce("stratum", F.lit(0)).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("cells"))


@R.add("j1_cell_match", "SELECT c_custkey AS a_id, o AS b_id FROM customer JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey")
def cell_match(spark: SparkSession, d: str) -> DataFrame:
    a = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_custkey", F.lit("@run1")).alias("name"))
    b = S.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("name", F.concat("id", F.lit("@run2")))
    return align.cell_match(a, b)


@R.add("j2_tolerant_align", "SELECT n_nationkey AS pos, n_name AS name, CASE WHEN n_regionkey <> 1 THEN n_nationkey END AS right_pos FROM nation")
def tolerant_align(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), "n_regionkey")
    return align.tolerant_align(n.select("pos", "name"), n.where("n_regionkey != 1").select("pos", "name"))


@R.add("j3_remap_features", sql("SELECT cell_id, feature_id, value FROM counts", "counts"))
def remap_features(spark: SparkSession, d: str) -> DataFrame:
    q = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.concat(F.lit("p-"), "p_partkey").alias("name"))
    return align.apply_remap(S.customer_counts(spark, d), align.remap_features(q, _spelled(spark, d)))


@R.add("j4_parent_partition", sql("SELECT batch, count(*) AS cells FROM cells GROUP BY 1", "cells"))
def parent_partition(spark: SparkSession, d: str) -> DataFrame:
    cells = S.customer_cells(spark, d)
    return align.strict_join(cells.select("cell_id"), cells.select("cell_id", "batch"), "cell_id", "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("cells"))


@R.add("j5_union_axis", "SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_regionkey > 2, n_name) - 1 AS BIGINT) AS pos FROM nation")
def union_axis(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = S.table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    known = n.where("n_regionkey <= 2").withColumn("pos", (F.row_number().over(Window.orderBy("name")) - 1).cast("long")).select("name", "pos")
    return align.union_axis(known, n.select("name")).withColumn("pos", F.col("pos").cast("long"))


@R.add("j6_multimodal_names", "SELECT concat(l_returnflag, '/flag') AS feature, concat(o_custkey, '@', o_orderstatus) AS cell, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def multimodal_names(spark: SparkSession, d: str) -> DataFrame:
    l = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = l.groupBy(F.col("l_returnflag").alias("feature"), F.col("o_custkey").alias("cell"), F.col("o_orderstatus").alias("grp")).agg(F.count(F.lit(1)).alias("value"))
    return align.namespaced(c, "flag", F.col("grp")).select("feature", "cell", "value")


@R.add(
    "j7_modality_vote",
    sql(
        "SELECT query, block, shared, count(*) OVER (PARTITION BY block) > 1 AS disputed FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, block) AS r FROM s) WHERE r = 1",
        s="SELECT q.l_returnflag AS query, p_brand AS block, count(*) AS shared FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem) q JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    ),
)
def modality_vote(spark: SparkSession, d: str) -> DataFrame:
    q = S.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("modality"), F.col("l_partkey").alias("name")).distinct()
    return align.modality_vote(q, S.table(spark, d, "part").select(F.col("p_brand").alias("modality"), F.col("p_partkey").alias("name")))


@R.add("j8_batch_delta", "SELECT c_nationkey AS batch, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(CASE WHEN c_nationkey < 10 THEN 1 + r_regionkey / 10.0 ELSE 1.0 END), 6) AS DOUBLE) AS delta FROM customer CROSS JOIN region GROUP BY 1")
def batch_delta(spark: SparkSession, d: str) -> DataFrame:
    cells = S.customer_cells(spark, d)
    f = S.table(spark, d, "region").select(F.col("r_regionkey").alias("feature_id"))
    trained = cells.where("batch < 10").select("batch").distinct().crossJoin(f).withColumn("delta", 1 + F.col("feature_id") / 10.0)
    return align.batch_delta(cells, trained).join(cells.select("cell_id", "batch"), "cell_id").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("delta"), 6).alias("delta"))


@R.add(
    "j9_windows",
    sql(
        "SELECT chr, win, count(*) AS regions FROM (SELECT chr, concat(chr, ':', w * 30, '-', (w + 1) * 30) AS win FROM (SELECT chr, unnest(range(lo, hi + 1)) AS w FROM r)) GROUP BY 1, 2",
        r="SELECT o_orderpriority AS chr, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 30.0) AS BIGINT) AS lo, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 44) / 30.0) AS BIGINT) AS hi FROM orders",
    ),
)
def window_tiling(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    o = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("chr"), day.alias("start"), (day + 45).alias("end"))
    return align.windows(o, 30).groupBy("chr", F.col("window").alias("win")).agg(F.count(F.lit(1)).alias("regions"))


@R.add("j10_hierarchy", "SELECT concat('N:', n_nationkey) AS child, concat('R:', n_regionkey) AS parent FROM nation WHERE n_regionkey <> 3")
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("http://x/N_"), "n_nationkey").alias("child"), F.concat(F.lit("R_"), "n_regionkey").alias("parent"))
    terms = n.select(F.concat(F.lit("N:"), "n_nationkey").alias("term")).union(S.table(spark, d, "region").where("r_regionkey != 3").select(F.concat(F.lit("R:"), "r_regionkey")))
    return align.present_hierarchy(edges, terms)


@R.add("j12_dense_labels", "SELECT vec_id AS cell_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label FROM embeddings WHERE label <> 4")
def dense_labels(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.when(F.col("label") != 4, F.col("label")).alias("label"))
    return align.dense_labels(e).withColumn("label", F.col("label").cast("int"))


@R.add("j14_carried_rows", "SELECT n_name AS name, n_regionkey > 1 AS carried FROM nation")
def carried_rows(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return align.carry_rows(n.where("n_regionkey <= 1").select("name"), n.select("name"))


@R.add("p1_keep_features", sql("SELECT c.cell_id, CAST(sum(value) AS BIGINT) AS total FROM counts c JOIN features f USING (feature_id) WHERE brand = 'Brand#11' GROUP BY 1", "counts", "features"))
def keep_features(spark: SparkSession, d: str) -> DataFrame:
    f = S.part_features(spark, d).where("brand = 'Brand#11'")
    return filters.keep_features(S.customer_counts(spark, d), f).groupBy("cell_id").agg(F.sum("value").alias("total"))


@R.add("p7_hide_features", sql("SELECT c.cell_id, CAST(sum(value) AS BIGINT) AS total FROM counts c JOIN features f USING (feature_id) WHERE brand <> 'Brand#11' GROUP BY 1", "counts", "features"))
def hide_features(spark: SparkSession, d: str) -> DataFrame:
    f = S.part_features(spark, d).where("brand = 'Brand#11'")
    return filters.hide_features(S.customer_counts(spark, d), f).groupBy("cell_id").agg(F.sum("value").alias("total"))


@R.add(
    "p2_cell_qc",
    sql(
        "SELECT cell_id, total, total >= 500 AS emit_keep, total >= 500 AND abs(x - med) <= 3.0 * 1.4826 * mad AS train_keep FROM t, m, (SELECT median(abs(x - med)) AS mad FROM t, m)",
        "counts",
        "cells",
        t="SELECT c.cell_id, CAST(coalesce(sum(value), 0) AS BIGINT) AS total, ln(1 + coalesce(sum(value), 0)) AS x FROM cells c LEFT JOIN counts USING (cell_id) GROUP BY 1",
        m="SELECT median(x) AS med FROM t",
    ),
)
def cell_qc(spark: SparkSession, d: str) -> DataFrame:
    return filters.cell_qc(S.customer_counts(spark, d), S.customer_cells(spark, d), near_empty=500)


_MOMENTS = "SELECT feature_id, sum(value) / CAST(n AS DOUBLE) AS mean, sum(value * value) / CAST(n AS DOUBLE) - (sum(value) / CAST(n AS DOUBLE)) * (sum(value) / CAST(n AS DOUBLE)) AS variance FROM counts, (SELECT count(*) AS n FROM customer) GROUP BY feature_id, n"


@R.add("p4_feature_moments", sql("SELECT feature_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m", "counts", m=_MOMENTS))
def feature_moments(spark: SparkSession, d: str) -> DataFrame:
    n = S.customer_cells(spark, d).agg(F.count(F.lit(1)).alias("n_cells"))
    m = filters.feature_moments(S.customer_counts(spark, d), n)
    return m.select("feature_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@R.add("p4_variable_features", sql("SELECT feature_id FROM m ORDER BY round(variance / mean, 9) DESC, feature_id LIMIT 50", "counts", m=_MOMENTS))
def variable_features(spark: SparkSession, d: str) -> DataFrame:
    n = S.customer_cells(spark, d).agg(F.count(F.lit(1)).alias("n_cells"))
    return filters.variable_features(S.customer_counts(spark, d), n, 50)


@R.add(
    "p6_kinetic_features",
    sql(
        "SELECT feature_id FROM v ORDER BY round(v, 9) DESC, feature_id LIMIT 20",
        t="SELECT l_partkey AS feature_id, l_suppkey AS pb, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS u, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2",
        dp="SELECT pb, CAST(sum(u + s) AS DOUBLE) AS depth FROM t GROUP BY 1",
        e="SELECT feature_id FROM t GROUP BY 1 HAVING sum(u) >= 200 AND sum(s) >= 200",
        v="SELECT feature_id, sum(y * y) / n - (sum(y) / n) * (sum(y) / n) AS v FROM (SELECT feature_id, ln(1 + 10000.0 * (u + s) / depth) AS y FROM t JOIN dp USING (pb) WHERE feature_id IN (SELECT feature_id FROM e)), (SELECT count(*) AS n FROM dp) GROUP BY feature_id, n",
    ),
)
def kinetic_features(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0)).cast("long")
    t = S.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("pb")).agg(q(F.col("l_returnflag") == "N").alias("u"), q(F.col("l_returnflag") != "N").alias("s"))
    depth = t.groupBy("pb").agg(F.sum(F.col("u") + F.col("s")).cast("double").alias("depth"))
    return filters.kinetic_features(t, depth, 200, 20)


@R.add(
    "p10_covering_groups",
    sql(
        "SELECT pb, n, CAST(r - 1 AS BIGINT) AS new_pb FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, pb ROWS UNBOUNDED PRECEDING) - n AS before, row_number() OVER (ORDER BY n DESC, pb) AS r, sum(n) OVER () AS t FROM s) WHERE before < ceil(t * 0.8)",
        s="SELECT c_nationkey AS pb, count(*) AS n FROM customer GROUP BY 1",
    ),
)
def covering_groups(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("pb")).agg(F.count(F.lit(1)).alias("n"))
    return filters.covering_groups(s, 0.8).withColumn("new_pb", F.col("new_pb").cast("long"))


@R.add(
    "p11_drop_small",
    sql(
        "SELECT c.c_custkey AS cell_id, k.new_label AS label FROM customer c LEFT JOIN k ON k.label = c_nationkey",
        k="SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS new_label FROM (SELECT c_nationkey AS label FROM customer GROUP BY 1 HAVING count(*) >= 60)",
    ),
)
def drop_small(spark: SparkSession, d: str) -> DataFrame:
    l = S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("label"))
    return filters.drop_small(l, 60).withColumn("label", F.col("label").cast("int"))


@R.add(
    "p12_fold_small",
    sql(
        "SELECT id AS cell_id, label FROM latent WHERE label IN (SELECT label FROM k) UNION ALL SELECT id, label FROM (SELECT l.id, c.label, row_number() OVER (PARTITION BY l.id ORDER BY round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(l.vec, c.m)]), 9), c.label) AS r FROM latent l CROSS JOIN c WHERE l.label NOT IN (SELECT label FROM k)) WHERE r = 1",
        "latent",
        "dims",
        k="SELECT label FROM latent GROUP BY 1 HAVING count(*) >= 50",
        c="SELECT label, list(m ORDER BY dim) AS m FROM (SELECT label, dim, avg(x) AS m FROM dims WHERE label IN (SELECT label FROM k) GROUP BY 1, 2) GROUP BY 1",
    ),
)
def fold_small(spark: SparkSession, d: str) -> DataFrame:
    p = S.latent(spark, d)
    return filters.fold_small(p.select("cell_id", "label"), p.select("cell_id", "vec"), 50)


@R.add("s6_bulk_long", "SELECT name, sample, value FROM (UNPIVOT (SELECT p_name AS name, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part) ON size, price INTO NAME sample VALUE value)")
def bulk_long(spark: SparkSession, d: str) -> DataFrame:
    """A wide table with a name column, as rows."""
    p = S.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    return align.bulk_long(p)


@R.add(
    "p13_baseline",
    sql(
        "SELECT feature_id FROM b WHERE s >= (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM b) WHERE r = n // 2)",
        b="SELECT p_partkey AS feature_id, p_retailprice AS s FROM part",
    ),
)
def baseline(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_low_baseline(S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("s")), "s").select("feature_id")


@R.add(
    "p14_winsorize",
    sql(
        "SELECT id, dim, round(CASE WHEN mad <= 1e-12 OR n < 8 THEN x ELSE least(greatest(x, med - 2 * 1.4826 * mad), med + 2 * 1.4826 * mad) END, 6) AS value FROM dims JOIN m USING (dim) JOIN a USING (dim)",
        "latent",
        "dims",
        m="SELECT dim, list_sort(list(x))[count(*) // 2 + 1] AS med, count(*) AS n FROM dims GROUP BY 1",
        a="SELECT dim, list_sort(list(abs(x - med)))[count(*) // 2 + 1] AS mad FROM dims JOIN m USING (dim) GROUP BY 1",
    ),
)
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    p = S.latent(spark, d).select(F.col("cell_id").alias("id"), F.posexplode("vec").alias("dim", "value"))
    return filters.winsorize(p, 2.0).select("id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@R.add("u1_union_files", sql("SELECT 'a' AS f, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderstatus <> 'F'"))
def union_files(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").withColumn("f", F.lit("a")).unionByName(o.where("o_orderstatus != 'F'").withColumn("f", F.lit("b"))).groupBy("f").agg(F.count(F.lit(1)).alias("n"))


@R.add("u3_shared_features", "SELECT l_partkey AS feature_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def shared_features(spark: SparkSession, d: str) -> DataFrame:
    l = S.table(spark, d, "lineitem")
    return l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("feature_id")).intersect(l.where("l_returnflag = 'A'").select("l_partkey"))


@R.add("u4_unrecorded_inputs", "SELECT concat('data/', n_name) AS path FROM nation WHERE n_regionkey <> 2")
def unrecorded(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation")
    return align.refuse_recorded(n.select(F.concat(F.lit("data/"), "n_name").alias("path")), n.where("n_regionkey = 2").select(F.concat(F.lit("data//"), "n_name").alias("path")))


@R.add("u5_disjoint_roles", "SELECT count(*) AS cells, count(*) AS assigned FROM customer")
def disjoint_roles(spark: SparkSession, d: str) -> DataFrame:
    r = rank.roles(S.customer_cells(spark, d), "cell_id", 3)
    parts = r.groupBy("cell_id").agg(F.count_distinct("role").alias("k"))
    return parts.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("k") == 1).alias("assigned"))


@R.add("f12_names", "SELECT p_partkey AS feature_id, lower(concat('P', p_partkey)) AS key, concat('EFO:', p_size) AS term FROM part")
def names(spark: SparkSession, d: str) -> DataFrame:
    f = _spelled(spark, d).join(S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), "p_size"), "feature_id")
    return f.select("feature_id", N.match_key("name").alias("key"), N.curie(F.concat(F.lit("http://www.ebi.ac.uk/efo/EFO_"), "p_size")).alias("term"))


@R.add("f13_group_token", r"SELECT p_partkey AS feature_id, regexp_replace(trim(p_type), '[\s/]+', '_', 'g') AS token FROM part")
def group_token(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), N.group_token("p_type").alias("token"))


@R.add("f14_parse_weight", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value >= 0 THEN value END AS weight FROM events")
def parse_weight(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    return e.select("event_id", N.parse_weight(F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))).alias("weight"))
