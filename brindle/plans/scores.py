"""Queries: held-out scores, batch ratios, collapse, decomposition, mixtures, carried summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregate as A
from brindle.operators import collapse as K
from brindle.operators import incremental as I
from brindle.operators import mixtures as M
from brindle.operators import multilevel as ML
from brindle.operators import score as P
from brindle.plans.base import Registry, drawn_sql, sql
from brindle.sources import counts as S

R = Registry()

_NULL = "SELECT cell_id, CAST(sum(value) AS BIGINT) AS total, sum(value * ln(greatest(share, 1e-12))) AS llik FROM counts JOIN composition USING (feature_id) GROUP BY 1"


@R.add("h7_null_scores", sql("SELECT cell_id, total, round(llik, 4) AS llik FROM n", "counts", "composition", n=_NULL))
def null_scores(spark: SparkSession, d: str) -> DataFrame:
    """Customers' multinomial log-likelihood under the composition of all."""
    c = S.customer_counts(spark, d)
    return P.null_scores(c, A.composition(c)).withColumn("llik", F.round("llik", 4))


def _segment_sums(spark: SparkSession, d: str) -> DataFrame:
    return A.grouped_sums(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("stratum").alias("label")))


_SEG = "SELECT stratum, feature_id, CAST(sum(value) AS DOUBLE) AS rate FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2"
_MODEL = "SELECT cell_id, CAST(sum(value) AS BIGINT) AS total, sum(value * ln(greatest(p, 1e-12))) AS llik FROM counts JOIN cells USING (cell_id) JOIN (SELECT stratum, feature_id, rate / sum(rate) OVER (PARTITION BY stratum) AS p FROM sg) USING (stratum, feature_id) GROUP BY 1"


@R.add("h7_model_scores", sql("SELECT cell_id, total, round(llik, 4) AS llik FROM m", "counts", "cells", sg=_SEG, m=_MODEL))
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    groups = S.customer_cells(spark, d).select("cell_id", F.col("stratum").alias("group"))
    rates = _segment_sums(spark, d).select(F.col("label").alias("group"), "feature_id", F.col("total").cast("double").alias("rate"))
    return P.multinomial_scores(S.customer_counts(spark, d), rates, groups).withColumn("llik", F.round("llik", 4))


@R.add("h7_ceiling", sql("SELECT cell_id, round(sum(value * ln(value / CAST(t AS DOUBLE))), 4) AS ceiling FROM (SELECT *, sum(value) OVER (PARTITION BY cell_id) AS t FROM counts WHERE value > 0) GROUP BY 1", "counts"))
def ceiling(spark: SparkSession, d: str) -> DataFrame:
    return P.ceiling_scores(S.customer_counts(spark, d)).withColumn("ceiling", F.round("ceiling", 4))


@R.add("h8_gain", sql("SELECT round((sum(m.llik) - sum(n.llik)) / sum(m.total), 6) AS gain, round(avg(m.llik / m.total), 6) AS mean_llik, round(avg(n.llik / n.total), 6) AS mean_null FROM m JOIN n USING (cell_id)", "counts", "cells", "composition", n=_NULL, sg=_SEG, m=_MODEL))
def gain(spark: SparkSession, d: str) -> DataFrame:
    c, cells = S.customer_counts(spark, d), S.customer_cells(spark, d)
    rates = _segment_sums(spark, d).select(F.col("label").alias("group"), "feature_id", F.col("total").cast("double").alias("rate"))
    model = P.multinomial_scores(c, rates, cells.select("cell_id", F.col("stratum").alias("group")))
    g = P.gain(P.predictive(cells, model, P.null_scores(c, A.composition(c))))
    return g.select(*[F.round(x, 6).alias(x) for x in ("gain", "mean_llik", "mean_null")])


@R.add("h9_predictive", sql("SELECT c.cell_id, coalesce(n.total, 0) AS total, round(m.llik / nullif(m.total, 0), 6) AS llik_per_count, round(n.llik / nullif(n.total, 0), 6) AS null_per_count FROM cells c LEFT JOIN m USING (cell_id) LEFT JOIN n USING (cell_id)", "counts", "cells", "composition", n=_NULL, sg=_SEG, m=_MODEL))
def predictive(spark: SparkSession, d: str) -> DataFrame:
    c, cells = S.customer_counts(spark, d), S.customer_cells(spark, d)
    rates = _segment_sums(spark, d).select(F.col("label").alias("group"), "feature_id", F.col("total").cast("double").alias("rate"))
    t = P.predictive(cells, P.multinomial_scores(c, rates, cells.select("cell_id", F.col("stratum").alias("group"))), P.null_scores(c, A.composition(c)))
    return t.select("cell_id", "total", F.round("llik_per_count", 6).alias("llik_per_count"), F.round("null_per_count", 6).alias("null_per_count"))


_SUMS = dict(
    lb="SELECT batch, CAST(sum(value) AS DOUBLE) AS lib FROM counts JOIN cells USING (cell_id) GROUP BY 1",
    ob="SELECT batch, feature_id, CAST(sum(value) AS DOUBLE) AS obs FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2",
    ds="SELECT lb.batch, c.feature_id, coalesce(obs, 0) AS obs, lib * share AS pred FROM composition c CROSS JOIN lb LEFT JOIN ob ON ob.batch = lb.batch AND ob.feature_id = c.feature_id",
)


@R.add("h4_delta_sums", sql("SELECT batch, feature_id, CAST(obs AS BIGINT) AS obs, round(pred, 5) AS pred FROM ds", "counts", "cells", "composition", **_SUMS))
def delta_sums(spark: SparkSession, d: str) -> DataFrame:
    c = S.customer_counts(spark, d)
    s = P.delta_sums(c, S.customer_cells(spark, d), A.composition(c).withColumnRenamed("share", "rate"))
    return s.select("batch", "feature_id", F.col("obs").cast("long").alias("obs"), F.round("pred", 5).alias("pred"))


@R.add("h4_fitted_delta", sql("SELECT batch, feature_id, round(least(greatest(obs / greatest(pred, 1e-10), 0.01), 100), 5) AS delta FROM ds", "counts", "cells", "composition", **_SUMS))
def fitted_delta(spark: SparkSession, d: str) -> DataFrame:
    c = S.customer_counts(spark, d)
    s = P.delta_sums(c, S.customer_cells(spark, d), A.composition(c).withColumnRenamed("share", "rate"))
    return P.fitted_delta(s).withColumn("delta", F.round("delta", 5))


@R.add(
    "h5_crossfit_delta",
    sql(
        "SELECT batch, fold, feature_id, round(least(greatest((o + 1.0 * s) / greatest(p + 1.0, 1e-10), 0.01), 100), 5) AS delta FROM (SELECT *, sum(obs) OVER b - obs AS o, sum(pred) OVER b - pred AS p, sum(obs) OVER (PARTITION BY batch) / sum(pred) OVER (PARTITION BY batch) AS s FROM f WINDOW b AS (PARTITION BY batch, feature_id))",
        "counts",
        "cells",
        "composition",
        f="SELECT batch, stratum AS fold, feature_id, CAST(sum(value) AS DOUBLE) AS obs, any_value(share) * 1000 AS pred FROM counts JOIN cells USING (cell_id) JOIN composition USING (feature_id) GROUP BY 1, 2, 3",
    ),
)
def crossfit_delta(spark: SparkSession, d: str) -> DataFrame:
    c = S.customer_counts(spark, d)
    cells = S.customer_cells(spark, d).select("cell_id", "batch", F.col("stratum").alias("fold"))
    f = c.join(cells, "cell_id").groupBy("batch", "fold", "feature_id").agg(F.sum("value").cast("double").alias("obs")).join(A.composition(c), "feature_id").withColumn("pred", F.col("share") * 1000)
    return P.crossfit_delta(f).withColumn("delta", F.round("delta", 5))


@R.add("h3_delta_plan", "SELECT c_nationkey AS batch, CASE WHEN c_nationkey < 10 THEN 'Trained' ELSE 'Fitted' END AS plan FROM customer GROUP BY 1")
def delta_plan(spark: SparkSession, d: str) -> DataFrame:
    b = S.customer_cells(spark, d).select("batch").distinct()
    return P.delta_plan(b, b.where("batch < 10"), "auto")


@R.add("h6_adjusted_null", sql("SELECT batch, feature_id, round(v / sum(v) OVER (PARTITION BY batch), 9) AS share FROM (SELECT batch, feature_id, least(greatest(obs / greatest(pred, 1e-10), 0.01), 100) * share AS v FROM ds JOIN composition USING (feature_id))", "counts", "cells", "composition", **_SUMS))
def adjusted_null(spark: SparkSession, d: str) -> DataFrame:
    c = S.customer_counts(spark, d)
    null = A.composition(c)
    delta = P.fitted_delta(P.delta_sums(c, S.customer_cells(spark, d), null.withColumnRenamed("share", "rate")))
    return P.batch_adjusted_null(null, delta).withColumn("share", F.round("share", 9))


@R.add("h6_smoothed_null", sql("SELECT batch, feature_id, round(v / sum(v) OVER (PARTITION BY batch), 9) AS share FROM (SELECT batch, feature_id, obs + (SELECT count(*) FROM composition) * share AS v FROM ds JOIN composition USING (feature_id))", "counts", "cells", "composition", **_SUMS))
def smoothed_null(spark: SparkSession, d: str) -> DataFrame:
    c = S.customer_counts(spark, d)
    return P.smoothed_null(c, S.customer_cells(spark, d), A.composition(c)).withColumn("share", F.round("share", 9))


@R.add("h2_topic_rates", sql("SELECT o AS cell_id, l_partkey AS feature_id, round(sum(t * exp(b)), 6) AS rate FROM (SELECT s_suppkey AS o, r_regionkey AS k, (1 + (s_suppkey + r_regionkey) % 5) / 15.0 AS t FROM supplier, region) JOIN (SELECT p_partkey AS l_partkey, r_regionkey AS k, -((p_partkey + r_regionkey) % 7) / 2.0 AS b FROM part, region) USING (k) GROUP BY 1, 2"))
def topic_rates(spark: SparkSession, d: str) -> DataFrame:
    k = S.table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    theta = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id")).crossJoin(k).withColumn("theta", (1 + (F.col("cell_id") + F.col("k")) % 5) / 15.0)
    beta = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id")).crossJoin(k).withColumn("beta", -((F.col("feature_id") + F.col("k")) % 7) / 2.0)
    return P.topic_rates(theta, beta).withColumn("rate", F.floor(F.col("rate") * 1e6 + 0.5) / 1e6)  # as SQL rounds; a decimal for each of all pairs takes longer than their rates


@R.add("h10_residuals", sql("SELECT cell_id, feature_id, round(value / greatest(share * lam, 1e-12), 4) AS value FROM counts JOIN composition USING (feature_id) JOIN (SELECT cell_id, sum(value) / CAST(1 AS DOUBLE) AS lam FROM counts GROUP BY 1) USING (cell_id) WHERE value / greatest(share * lam, 1e-12) > 2".replace("sum(value) / CAST(1 AS DOUBLE)", "sum(value) / sum(share)"), "counts", "composition").replace("FROM counts GROUP BY 1) USING (cell_id)", "FROM counts JOIN composition USING (feature_id) GROUP BY 1) USING (cell_id)"))
def residuals(spark: SparkSession, d: str) -> DataFrame:
    """The value is that of whole numbers, rounded once; sums of shares differ with the order of rows, and in SQL a tie of the fourth place with them."""
    c = S.customer_counts(spark, d)
    totals = c.groupBy("feature_id").agg(F.sum("value").alias("rate"))  # shares but for a factor that cancels out
    rates = c.select("cell_id", "feature_id").join(totals, "feature_id")
    return P.residual_counts(c, rates, 2.0).withColumn("value", F.round("value", 4))


@R.add("h11_gaussian", sql("SELECT cell_id, round(-0.5 * 50 * (1 + ln(2 * pi() * greatest(sum(r * r) / 50, 1e-12))), 4) AS llik FROM (SELECT cell_id, ln(1 + value) - 3 AS r FROM counts) GROUP BY 1", "counts"))
def gaussian(spark: SparkSession, d: str) -> DataFrame:
    r = S.customer_counts(spark, d).select("cell_id", (F.log1p("value") - 3).alias("r"))
    return P.gaussian_scores(r, 50).select("cell_id", F.round("llik", 4).alias("llik"))


@R.add(
    "h9_feature_agreement",
    sql(
        "SELECT feature_id, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(rx, ry), 5) END AS spearman, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(ln(1 + x), ln(1 + y)), 5) END AS pearson_log1p, round(avg(x), 5) AS mean_observed FROM (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY x) + (count(*) OVER (PARTITION BY feature_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature_id ORDER BY y) + (count(*) OVER (PARTITION BY feature_id, y) - 1) / 2.0 AS ry FROM p) GROUP BY 1",
        "counts",
        p="SELECT feature_id, CAST(value AS DOUBLE) AS x, sqrt(value) + 1 AS y FROM counts",
    ),
)
def feature_agreement(spark: SparkSession, d: str) -> DataFrame:
    c = S.customer_counts(spark, d)
    p = c.select("cell_id", "feature_id", (F.sqrt("value") + 1).alias("rate"))
    return P.feature_agreement(c, p).select("feature_id", F.round("spearman", 5).alias("spearman"), F.round("pearson_log1p", 5).alias("pearson_log1p"), F.round("mean_observed", 5).alias("mean_observed"))


#: Projection of customers on 10 dimensions, less the mean of their nation.
_R2 = dict(
    b=f"SELECT feature_id, dim, sqrt(-2 * ln({drawn_sql('feature_id', 'dim')})) * cos(2 * pi() * {drawn_sql('feature_id', 'dim', seed=1)}) AS g FROM (SELECT DISTINCT feature_id FROM counts), range(10) AS t(dim)",
    y="SELECT cell_id, dim, sum(ln(1 + value) * g) AS x FROM counts JOIN b USING (feature_id) GROUP BY 1, 2",
    j="SELECT cell_id, CAST(dim AS INTEGER) AS dim, x - avg(x) OVER (PARTITION BY batch, dim) AS x FROM y JOIN cells USING (cell_id)",
)


@R.add("r2_projection", sql("SELECT cell_id, dim, round(x, 6) AS x FROM j", "counts", "cells", **_R2))
def projection(spark: SparkSession, d: str) -> DataFrame:
    return K.project(S.customer_counts(spark, d), S.customer_cells(spark, d), 10).withColumn("x", F.round("x", 6))


@R.add("r3_sign_partition", sql("SELECT cell_id, code, CAST(dense_rank() OVER (ORDER BY code) - 1 AS INTEGER) AS pb FROM (SELECT cell_id, CAST(sum(CASE WHEN x > 0 THEN 2 ** dim ELSE 0 END) AS BIGINT) AS code FROM j WHERE dim < 6 GROUP BY 1)", "counts", "cells", **_R2))
def sign_partition(spark: SparkSession, d: str) -> DataFrame:
    cells = S.customer_cells(spark, d)
    return K.sign_partition(K.project(S.customer_counts(spark, d), cells, 10), 6)


_PB = "SELECT batch AS pb, feature_id, CAST(sum(value) AS BIGINT) AS total FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2"
_NP = "SELECT batch AS pb, count(*) AS n FROM cells GROUP BY 1"


def _pseudobulk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return K.pseudobulk(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")))


@R.add("r4_pseudobulk", sql("SELECT pb, feature_id, total, n AS n_cells FROM s JOIN z USING (pb)", "counts", "cells", s=_PB, z=_NP))
def pseudobulk(spark: SparkSession, d: str) -> DataFrame:
    s, n = _pseudobulk(spark, d)
    return s.join(n, "pb")


_BITS = {0: 1, 1: 3, 2: 6}
_CODES = ", ".join(f"({i}, {(1 << b) - 1})" for i, b in _BITS.items())
_PARTS = dict(code="SELECT cell_id, CAST(sum(CASE WHEN x > 0 THEN 2 ** dim ELSE 0 END) AS BIGINT) AS code FROM j WHERE dim < 6 GROUP BY 1", part=f"SELECT cell_id, level, code & mask AS pb FROM code, (VALUES {_CODES}) t(level, mask)")


def _collapsed(spark: SparkSession, d: str) -> ML.Collapsed:
    counts, cells = S.customer_counts(spark, d), S.customer_cells(spark, d)
    return ML.collapse(counts, cells, K.project(counts, cells, 10), bits=6)


@R.add("r4_levels", sql("SELECT level, pb, feature_id, CAST(sum(value) AS BIGINT) AS total FROM part JOIN counts USING (cell_id) GROUP BY 1, 2, 3", "counts", "cells", **_R2, **_PARTS))
def collapsed_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of every level, added up from the finest."""
    return _collapsed(spark, d).sums


@R.add("r10_tree", sql("SELECT a.level, a.pb, min(b.pb) AS parent, count(*) AS n FROM part a LEFT JOIN part b ON a.cell_id = b.cell_id AND b.level = a.level - 1 GROUP BY 1, 2", "counts", "cells", **_R2, **_PARTS))
def collapsed_tree(spark: SparkSession, d: str) -> DataFrame:
    return ML.outputs(_collapsed(spark, d))["pb_tree"]


@R.add(
    "r4_matches",
    sql(
        "SELECT pb, CAST(batch AS VARCHAR) AS batch, near_pb, CAST(near_batch AS VARCHAR) AS near_batch, CAST(rank AS INTEGER) AS rank FROM (SELECT a.pb, a.batch, b.pb AS near_pb, b.batch AS near_batch, row_number() OVER (PARTITION BY a.pb, a.batch ORDER BY round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.vec, b.vec)]), 9), b.pb, CAST(b.batch AS VARCHAR)) AS rank FROM m a JOIN m b ON a.batch <> b.batch) WHERE rank <= 10",
        "counts", "cells", **_R2, **_PARTS,
        m="SELECT pb, batch, list(m ORDER BY dim) AS vec FROM (SELECT pb, batch, dim, avg(x) AS m FROM j JOIN cells USING (cell_id) JOIN part USING (cell_id) WHERE level = 2 GROUP BY 1, 2, 3) GROUP BY 1, 2",
    ),
)
def collapsed_matches(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d).matches.drop("weight")


@R.add("r4_delta")
def collapsed_delta(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d).delta


def _batch_model_sql(passes: int) -> str:
    more = {
        "s": "SELECT stratum AS pb, batch, feature_id, sum(value) AS total FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3",
        "z": "SELECT stratum AS pb, batch, count(*) AS n FROM cells GROUP BY 1, 2",
        "d0": "SELECT DISTINCT batch, feature_id, CAST(1 AS DOUBLE) AS delta FROM s",
    }
    for i in range(1, passes + 1):
        more[f"e{i}"] = f"SELECT pb, feature_id, sum(n * coalesce(delta, 1)) AS e FROM (SELECT DISTINCT pb, feature_id FROM s) JOIN z USING (pb) LEFT JOIN d{i - 1} USING (batch, feature_id) GROUP BY 1, 2"
        more[f"m{i}"] = f"SELECT pb, feature_id, t / e AS mu FROM (SELECT pb, feature_id, sum(total) AS t FROM s GROUP BY 1, 2) JOIN e{i} USING (pb, feature_id)"
        more[f"d{i}"] = f"SELECT batch, feature_id, least(greatest((o + 1) / (p + 1), 0.01), 100) AS delta FROM (SELECT batch, feature_id, sum(total) AS o FROM s GROUP BY 1, 2) JOIN (SELECT batch, feature_id, sum(mu * n) AS p FROM m{i} JOIN z USING (pb) GROUP BY 1, 2) USING (batch, feature_id)"
    return sql(f"SELECT pb, feature_id, round(mu, 5) AS mu FROM m{passes}", "counts", "cells", **more)


@R.add("r5_batch_model", _batch_model_sql(3))
def batch_model(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators.shared import shared_folder

    cells = S.customer_cells(spark, d)
    c = S.customer_counts(spark, d).join(cells, "cell_id")
    sums = c.groupBy(F.col("stratum").alias("pb"), "batch", "feature_id").agg(F.sum("value").alias("total"))
    sizes = cells.groupBy(F.col("stratum").alias("pb"), "batch").agg(F.count(F.lit(1)).alias("n"))
    mu, _ = K.batch_model(sums, sizes, 3, shared_folder(spark))
    return mu.withColumn("mu", F.round("mu", 5))


@R.add("r9_dispersion", sql("SELECT feature_id, round(m, 6) AS mean, round(CASE WHEN v > m THEN m * m / (v - m) END, 4) AS phi FROM (SELECT feature_id, sum(total / CAST(n AS DOUBLE)) / k AS m, sum((total / CAST(n AS DOUBLE)) ** 2) / k - (sum(total / CAST(n AS DOUBLE)) / k) ** 2 AS v FROM s JOIN z USING (pb), (SELECT count(*) AS k FROM z) GROUP BY feature_id, k)", "counts", "cells", s=_PB, z=_NP))
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return K.dispersion(*_pseudobulk(spark, d)).select("feature_id", F.round("mean", 6).alias("mean"), F.round("phi", 4).alias("phi"))


@R.add("m1_log_rates", sql("SELECT pb, feature_id, round(ln(1 + 10000.0 * total / n), 6) AS x FROM s JOIN z USING (pb)", "counts", "cells", s=_PB, z=_NP))
def log_rates(spark: SparkSession, d: str) -> DataFrame:
    return K.log_rates(*_pseudobulk(spark, d)).select("pb", "feature_id", F.round("x", 6).alias("x"))


@R.add("m1_loadings")
def loadings(spark: SparkSession, d: str) -> DataFrame:
    return K.loadings(K.log_rates(*_pseudobulk(spark, d)), 5)


@R.add("m1_standardized_cells", sql("SELECT cell_id, feature_id, round(CASE WHEN s > 1e-12 THEN (y - m) / s ELSE 0 END, 5) AS x FROM (SELECT *, avg(y) OVER (PARTITION BY cell_id) AS m, stddev_pop(y) OVER (PARTITION BY cell_id) AS s FROM (SELECT cell_id, feature_id, ln(1 + 10000.0 * value / sqrt(sum(value * value) OVER (PARTITION BY cell_id))) AS y FROM counts))", "counts"))
def standardized(spark: SparkSession, d: str) -> DataFrame:
    return K.standardized_cells(S.customer_counts(spark, d)).withColumn("x", F.round("x", 5))


@R.add("m1_cell_embedding")
def cell_embedding(spark: SparkSession, d: str) -> DataFrame:
    u = K.loadings(K.log_rates(*_pseudobulk(spark, d)), 5)
    return K.nystrom(K.standardized_cells(S.customer_counts(spark, d)), u)


@R.add("x36_adjusted_triplets", sql("SELECT cell_id, feature_id, CAST(round(value / (1 + batch / 10.0)) AS BIGINT) AS value FROM counts JOIN cells USING (cell_id) WHERE round(value / (1 + batch / 10.0)) >= 1", "counts", "cells"))
def adjusted_triplets(spark: SparkSession, d: str) -> DataFrame:
    cells = S.customer_cells(spark, d)
    delta = cells.select("batch").distinct().crossJoin(S.part_features(spark, d).select("feature_id")).withColumn("delta", 1 + F.col("batch") / 10.0)
    return K.adjusted_triplets(S.customer_counts(spark, d), cells, delta)


@R.add("r7_coarsen", "SELECT p_partkey AS feature_id, CAST(dense_rank() OVER (ORDER BY floor(ln(p_retailprice) / 0.5)) - 1 AS INTEGER) AS grp FROM part")
def coarsen(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), "p_retailprice")
    return K.coarsen(p, 0.5, F.log("p_retailprice")).withColumn("grp", F.col("grp").cast("int"))


@R.add("x26_expand_dictionary", sql("SELECT feature_id, brand AS k, round(-1.0 + ln((coalesce(t, 0) + 0.5) / sum(coalesce(t, 0) + 0.5) OVER (PARTITION BY brand)), 6) AS beta FROM features LEFT JOIN (SELECT feature_id, sum(value) AS t FROM counts GROUP BY 1) USING (feature_id)", "counts", "features"))
def expand_dictionary(spark: SparkSession, d: str) -> DataFrame:
    f = S.part_features(spark, d).select("feature_id", F.col("brand").alias("grp"))
    beta = f.select("grp").distinct().select("grp", F.col("grp").alias("k"), F.lit(-1.0).alias("beta"))
    t = S.customer_counts(spark, d).groupBy("feature_id").agg(F.sum("value").alias("total"))
    return K.expand_dictionary(beta, f, t).withColumn("beta", F.round("beta", 6))


_PROF = dict(
    s="SELECT stratum AS label, feature_id, CAST(sum(value) AS DOUBLE) AS total FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2",
    n="SELECT stratum AS label, count(*) AS n FROM cells GROUP BY 1",
    pr="SELECT n.label, p.feature_id, (coalesce(total, 0) + 5.0 * pooled) / (n + 5.0) AS rate FROM (SELECT feature_id, sum(value) / CAST((SELECT count(*) FROM cells) AS DOUBLE) AS pooled FROM counts GROUP BY 1) p CROSS JOIN n LEFT JOIN s ON s.label = n.label AND s.feature_id = p.feature_id",
)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    labels = S.customer_cells(spark, d).select("cell_id", F.col("stratum").alias("label"))
    c = S.customer_counts(spark, d)
    return M.shrunk_profiles(A.grouped_sums(c, labels), labels, c)


@R.add("d2_shrunk_profiles", sql("SELECT label, feature_id, round(rate, 6) AS rate FROM pr", "counts", "cells", **_PROF))
def shrunk_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).withColumn("rate", F.round("rate", 6))


@R.add("d3_readout", "SELECT source AS component, quality AS type, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE), 6) AS a FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1, 2")
def readout(spark: SparkSession, d: str) -> DataFrame:
    cells = S.table(spark, d, "documents").select("doc_id", "source").join(S.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return M.readout(cells, "source", "quality").withColumn("a", F.round("a", 6))


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the supplier's nation, as bulk samples."""
    s = S.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sample"))
    return S.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("sample", F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))


def _draws(spark: SparkSession, d: str) -> DataFrame:
    return M.gibbs(_bulk(spark, d), _profiles(spark, d), warmup=20, draws=20, dispersion=10.0)


@R.add("d4_gibbs")
def gibbs(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d)


@R.add("d7_posterior")
def posterior(spark: SparkSession, d: str) -> DataFrame:
    return M.posterior(M.fractions(_draws(spark, d)))


#: Customers' balances as draws of a chain: a nation is a sample, a segment a type, a customer's number the chain and the place in it.
_GIVEN = "SELECT c_nationkey AS sample, c_mktsegment AS type, c_custkey % 2 AS chain, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 2 ORDER BY c_custkey) - 1 AS it, c_acctbal AS f FROM customer"


def _given(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("sample"), F.col("c_mktsegment").alias("type"), (F.col("c_custkey") % 2).alias("chain"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("f"))
    return c.select("sample", "type", "chain", (F.row_number().over(Window.partitionBy("sample", "type", "chain").orderBy("key")) - 1).alias("it"), "f")


@R.add("d7_summaries", sql("SELECT sample, type, round(avg(f), 6) AS mean, round(stddev_pop(f), 5) AS sd, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high FROM g GROUP BY 1, 2", g=_GIVEN))
def summaries(spark: SparkSession, d: str) -> DataFrame:
    return M.posterior(_given(spark, d)).select("sample", "type", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@R.add("d7_expression")
def expression(spark: SparkSession, d: str) -> DataFrame:
    return M.expression(_bulk(spark, d), _profiles(spark, d), warmup=20, draws=20, dispersion=10.0)


@R.add("d8_convergence")
def convergence(spark: SparkSession, d: str) -> DataFrame:
    return M.convergence(M.fractions(_draws(spark, d)))


_RHAT = "SELECT sample, type, avg(v) AS within, var_samp(m) AS b, avg(k) AS k, count(*) AS chains FROM (SELECT sample, type, {keys}, avg(f) AS m, var_samp(f) AS v, count(*) AS k FROM l GROUP BY ALL) GROUP BY 1, 2"


@R.add(
    "d8_diagnostics",
    sql(
        "SELECT sample, type, round(sqrt(((h.k - 1) / h.k * h.within + h.b) / h.within), 6) AS rhat, round(sqrt(((c.k - 1) / c.k * c.within + c.b) / c.within), 6) AS between, round(ess, 4) AS ess, round(least(greatest(c.k * c.chains * ((c.k - 1) / c.k * c.within + c.b) / greatest(c.k * c.b, 1e-12), 1.0), c.k * c.chains), 4) AS ess_between FROM h JOIN c USING (sample, type) JOIN e USING (sample, type) WHERE c.chains > 1",
        g=_GIVEN,
        l="SELECT * FROM (SELECT *, count(*) OVER w AS n, CAST(row_number() OVER (w ORDER BY it) > count(*) OVER w / 2.0 AS INT) AS half FROM g WINDOW w AS (PARTITION BY sample, type, chain)) WHERE n >= 8",
        h=_RHAT.format(keys="chain, half"), c=_RHAT.format(keys="chain"),
        m="SELECT sample, type, chain, n, it, f - avg(f) OVER (PARTITION BY sample, type, chain) AS x FROM l",
        a="SELECT p.sample, p.type, p.chain, p.n, q.it - p.it AS lag, sum(p.x * q.x) AS s FROM m p JOIN m q ON p.sample = q.sample AND p.type = q.type AND p.chain = q.chain AND q.it >= p.it GROUP BY ALL",
        r="SELECT sample, type, chain, n, lag // 2 AS pair, sum(s / z) AS rho FROM a JOIN (SELECT sample, type, chain, s AS z FROM a WHERE lag = 0) USING (sample, type, chain) WHERE lag < n - n % 2 GROUP BY ALL",
        t="SELECT sample, type, chain, any_value(n) AS n, 2 * sum(rho) FILTER (low > 0) - 1 AS tau FROM (SELECT *, min(rho) OVER (PARTITION BY sample, type, chain ORDER BY pair) AS low FROM r) GROUP BY 1, 2, 3",
        e="SELECT sample, type, sum(least(greatest(n / greatest(tau, 1e-12), 1.0), n)) AS ess FROM t GROUP BY 1, 2",
    ),
)
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return M.convergence(_given(spark, d)).select("sample", "type", F.round("rhat", 6).alias("rhat"), F.round("between", 6).alias("between"), F.round("ess", 4).alias("ess"), F.round("ess_between", 4).alias("ess_between"))


@R.add("d10_trace")
def trace(spark: SparkSession, d: str) -> DataFrame:
    return M.trace(M.fractions(M.gibbs(_bulk(spark, d), _profiles(spark, d), warmup=20, draws=20, chains=1, dispersion=10.0, keep_warmup=True)), 5)


@R.add("d10_checkpoints", sql("SELECT sample, type, it, draws, round(mean, 6) AS mean FROM (SELECT sample, type, it, CAST(sum(n) OVER w AS BIGINT) AS draws, sum(s) OVER w / sum(n) OVER w AS mean FROM (SELECT sample, type, it, sum(f) AS s, count(*) AS n FROM g GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY sample, type ORDER BY it)) WHERE (it + 1) % 3 = 0", g=_GIVEN))
def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return M.checkpoints(_given(spark, d), 3).withColumn("mean", F.round("mean", 6))


@R.add(
    "d9_deviance",
    sql(
        "SELECT sample, round(sum(2 * (CASE WHEN y > 0 THEN y * ln(y / l) ELSE 0 END - (y - l))), 2) AS deviance, round(sum((y - l) * (y - l) / l), 2) AS pearson FROM (SELECT f.sample, coalesce(value, 0) AS y, greatest(lam, 1e-12) AS l FROM f LEFT JOIN b ON b.sample = f.sample AND b.feature_id = f.feature_id) GROUP BY 1",
        "counts",
        "cells",
        **_PROF,
        b="SELECT s_nationkey AS sample, l_partkey AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2",
        f="SELECT sample, feature_id, sum(rate * 10.0) AS lam FROM (SELECT DISTINCT sample FROM b) CROSS JOIN pr GROUP BY 1, 2",
    ),
)
def deviance(spark: SparkSession, d: str) -> DataFrame:
    b = _bulk(spark, d)
    w = b.select("sample").distinct().crossJoin(S.customer_cells(spark, d).select(F.col("stratum").alias("label")).distinct()).withColumn("w", F.lit(10.0))
    return M.deviance(b, M.expected(_profiles(spark, d), w)).select("sample", F.round("deviance", 2).alias("deviance"), F.round("pearson", 2).alias("pearson"))


@R.add(
    "d11_benchmark",
    "WITH t AS (SELECT c_nationkey AS sample, c_mktsegment AS type, count(*) / CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS DOUBLE) AS x FROM customer GROUP BY 1, 2), g AS (SELECT sample, type, x * x / sum(x * x) OVER (PARTITION BY sample) AS y FROM t) SELECT type, round(avg(abs(x - y)), 6) AS mae, round(avg(y - x), 6) AS bias, round(regr_slope(y, x), 5) AS slope, round(corr(x, y), 5) AS pearson FROM t JOIN g USING (sample, type) GROUP BY 1",
)
def benchmark(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("sample")
    n = S.customer_cells(spark, d).groupBy(F.col("batch").alias("sample"), F.col("stratum").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    t = n.select("sample", "type", (F.col("n") / F.sum("n").over(w)).alias("f"))
    g = t.select("sample", "type", (F.col("f") * F.col("f") / F.sum(F.col("f") * F.col("f")).over(w)).alias("f"))
    b = M.benchmark(t, g)
    return b.select("type", F.round("mae", 6).alias("mae"), F.round("bias", 6).alias("bias"), F.round("slope", 5).alias("slope"), F.round("pearson", 5).alias("pearson"))


@R.add("i1_carried_merge", sql("SELECT pb, feature_id, round(total / CAST(n AS DOUBLE), 6) AS rate, n AS n_cells FROM s JOIN z USING (pb)", "counts", "cells", s=_PB, z=_NP))
def carried_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of customers, merged, equal one round of all."""
    c, cells = S.customer_counts(spark, d), S.customer_cells(spark, d)
    part = lambda cond, g: I.evidence(*K.pseudobulk(c, cells.where(cond).select("cell_id", F.col("batch").alias("pb"))), g)
    return I.merge(part("stratum in ('BUILDING', 'MACHINERY')", 0), part("stratum not in ('BUILDING', 'MACHINERY')", 1)).select("pb", "feature_id", F.round("rate", 6).alias("rate"), "n_cells")


@R.add("i2_column_weights", sql("SELECT cell_id, CASE WHEN batch = 3 THEN CAST(7 AS BIGINT) ELSE 1 END AS weight FROM cells", "cells"))
def column_weights(spark: SparkSession, d: str) -> DataFrame:
    cells = S.customer_cells(spark, d)
    carried = cells.where("batch = 3").select("name", F.lit(7).cast("long").alias("n_cells"))
    return I.weights(cells, carried).withColumn("weight", F.col("weight").cast("long"))
