"""Queries: neighbours, clustering, comparison of latents, novelty, imputation, views, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import aggregate as A
from brindle.operators import cluster as C
from brindle.operators import communities as Q
from brindle.operators import flow as O
from brindle.operators import index as I
from brindle.operators import neighbours as N
from brindle.operators import score as P
from brindle.operators import trajectory as T
from brindle.operators import view as W
from brindle.plans.base import CTES, Registry, drawn_sql, sql
from brindle.sources import counts as S

R = Registry()

_D2 = "round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.vec, b.vec)]), 9)"
_KNN = f"SELECT a, b, d2, r AS rank FROM (SELECT a.id AS a, b.id AS b, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS r FROM latent a JOIN latent b ON a.id <> b.id) WHERE r <= 10"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return S.latent(spark, d).withColumnRenamed("cell_id", "id")


@R.add("n1_nearest", sql(f"SELECT a, b, round(d2, 6) AS d2, rank FROM ({_KNN})", "latent"))
def nearest(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return N.nearest(p, p, 10, same=True).select("a", "b", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


#: Lists of the index whose centers are rows, so that SQL can say it; lists read.
_LISTS, _PROBES = 12, 5
_INDEX = dict(
    centers=f"SELECT list, vec FROM (SELECT vec, row_number() OVER (ORDER BY {drawn_sql('id')}, id) - 1 AS list FROM latent) WHERE list < {_LISTS}",
    places=f"SELECT a.id, b.list, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.list) AS place FROM latent a, centers b",
)
_FOUND = f"SELECT a.id AS a, b.id AS b, {_D2} AS d2 FROM latent a JOIN places p ON p.id = a.id AND p.place <= {_PROBES} JOIN places l ON l.list = p.list AND l.place = 1 JOIN latent b ON b.id = l.id AND b.id <> a.id"


@R.add("n2_lists", sql("SELECT a, b, round(d2, 6) AS d2, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM f) WHERE r <= 10", "latent", **_INDEX, f=_FOUND))
def in_lists(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return I.search(I.build(p, _LISTS, passes=0), p, 10, _PROBES, same=True).select("a", "b", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


@R.add(
    "n2_recall",
    sql(
        "SELECT n.probes, round(coalesce((SELECT count(*) FROM t WHERE place <= n.probes), 0) / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) AS recall, round((SELECT count(*) FROM places p JOIN places l ON l.list = p.list AND l.place = 1 WHERE p.place <= n.probes) / CAST((SELECT count(*) * count(*) FROM latent) AS DOUBLE), 6) AS read FROM n",
        "latent", k=_KNN, **_INDEX, n=f"SELECT unnest(range(1, {_LISTS} + 1)) AS probes", t="SELECT p.place FROM k JOIN places l ON l.id = k.b AND l.place = 1 JOIN places p ON p.id = k.a AND p.list = l.list",
    ),
)
def recall_by_lists(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    r = I.recall_by_probes(I.build(p, _LISTS, passes=0), N.nearest(p, p, 10, same=True), p)
    return r.select(F.col("probes").cast("long").alias("probes"), F.round("recall", 6).alias("recall"), F.round("read", 6).alias("read"))


@R.add("n2_approximate")
def approximate(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen neighbours of every point by k-means lists, as many as find nine in ten."""
    p = _points(spark, d)
    return I.approximate(p, p, 15, same=True)


@R.add(
    "n3_by_direction",
    sql(f"SELECT a, b, round(-sqrt(d2), 6) AS score, r AS rank FROM (SELECT a.id AS a, b.id AS b, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS r FROM u a JOIN u b ON a.id <> b.id) WHERE r <= 5", "latent", u="SELECT id, [x / sqrt(list_sum([y * y FOR y IN vec])) FOR x IN vec] AS vec FROM latent"),
)
def by_direction(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return N.by_direction(p, p, 5, same=True).select("a", "b", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.add(
    "n4_fuzzy_graph",
    sql(
        "SELECT src, dst, round(s - CASE WHEN n = 2 THEN lo * hi ELSE 0 END, 5) AS weight FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(w) AS s, count(*) AS n, min(w) AS lo, max(w) AS hi FROM w GROUP BY 1, 2)",
        "latent",
        k=_KNN,
        w="SELECT a, b, exp(-(sqrt(d2) - low) / greatest(mid - low, 1e-9)) AS w FROM k JOIN (SELECT a, min(sqrt(d2)) AS low, avg(sqrt(d2)) AS mid FROM k GROUP BY 1) USING (a)",
    ),
)
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    return N.fuzzy_graph(_points(spark, d), 10).withColumn("weight", F.round("weight", 5))


@R.add("n5_metrics", sql("SELECT id, round(sum(sqrt(t)), 6) AS hellinger, round(sum(u), 6) AS cosine FROM (SELECT id, exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY id) AS t, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS u FROM (SELECT *, max(x) OVER (PARTITION BY id) AS mx FROM dims)) GROUP BY 1", "latent", "dims"))
def metrics(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "vec")
    h = N.in_metric(p.withColumn("vec", V.softmax("vec")), "log_simplex").select("id", F.round(V.total("vec"), 6).alias("hellinger"))
    return h.join(N.in_metric(p, "embedding").select("id", F.round(V.total("vec"), 6).alias("cosine")), "id")


@R.add("c1_k_means")
def k_means(spark: SparkSession, d: str) -> DataFrame:
    return C.k_means(_points(spark, d), 10)


@R.add(
    "c1_nearest_centroid",
    sql(f"SELECT id, cluster FROM (SELECT a.id, b.label AS cluster, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.label) AS r FROM latent a CROSS JOIN c b) WHERE r = 1", "latent", "dims", c="SELECT label, list(m ORDER BY dim) AS vec FROM (SELECT label, dim, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1"),
)
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    m = A.vector_mean(p, ["label"]).select(F.col("label").alias("cluster"), F.col("mean").alias("center"))
    return C.nearest_centroid(p, m)


@R.add("c2_communities")
def communities(spark: SparkSession, d: str) -> DataFrame:
    return C.communities(N.fuzzy_graph(_points(spark, d), 15))


@R.add("c2_refined")
def refined_communities(spark: SparkSession, d: str) -> DataFrame:
    return Q.refined(N.fuzzy_graph(_points(spark, d), 15))


@R.add("c2_target")
def targeted_communities(spark: SparkSession, d: str) -> DataFrame:
    """The resolution whose count is nearest to 12."""
    return Q.refined(N.fuzzy_graph(_points(spark, d), 15), target=12, passes=2)


_MOD = "SELECT a.c AS a, b.c AS b, w FROM (SELECT src, dst, w FROM k UNION ALL SELECT dst, src, w FROM k) JOIN l a ON a.id = src JOIN l b ON b.id = dst"


@R.add(
    "c2_modularity",
    sql(
        "SELECT round(sum(inn) / sum(vol) - sum(vol * vol) / (sum(vol) * sum(vol)), 6) AS modularity FROM (SELECT a, sum(w) AS vol, sum(CASE WHEN a = b THEN w ELSE 0 END) AS inn FROM m GROUP BY 1)",
        "latent", n=_KNN, k="SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) * 1.0 AS w FROM n GROUP BY 1, 2", l="SELECT id, label AS c FROM latent", m=_MOD,
    ),
)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Of the labels over the graph of ten neighbours, an edge that both ends hold counting twice."""
    p = _points(spark, d)
    e = N.nearest(p, p, 10, same=True).groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return Q.modularity(e, p.select(F.col("id").alias("node"), F.col("label").alias("community"))).select(F.round("modularity", 6).alias("modularity"))


#: Passes that SQL relaxes distances for: over the hops of any shortest way in these graphs.
_HOPS = 14


def _ways_sql(name: str, start: str) -> str:
    """Expressions ``name`` (node, dist): distances from the nodes of ``start`` over the edges e."""
    out = [f"{name}0 AS MATERIALIZED (SELECT node, 0.0::DOUBLE AS dist FROM ({start}))"]
    for i in range(1, _HOPS + 1):
        out.append(f"{name}{i} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT node, dist FROM {name}{i - 1} UNION ALL SELECT dst, round(dist + w, 9) FROM {name}{i - 1} JOIN e ON src = node) GROUP BY 1)")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT * FROM {name}{_HOPS})"])


_EDGES = f"latent AS MATERIALIZED ({CTES['latent']}), k AS MATERIALIZED ({_KNN}), e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a AS src, b AS dst, round(sqrt(d2), 9) AS w FROM k UNION ALL SELECT b, a, round(sqrt(d2), 9) FROM k))"
_FARTHEST = "SELECT node FROM ({}) ORDER BY dist DESC, node LIMIT 1"
_TREE = ", ".join([
    _EDGES, _ways_sql("r", "SELECT id AS node FROM latent WHERE label = 0"), _ways_sql("a", _FARTHEST.format("SELECT * FROM r")),
    _ways_sql("b", _FARTHEST.format("SELECT node, min(dist) AS dist FROM (SELECT * FROM r UNION ALL SELECT * FROM a) GROUP BY 1")),
    "tips AS MATERIALIZED (SELECT 0 AS lineage, node AS tip FROM a WHERE dist = 0 UNION ALL SELECT 1, node FROM b WHERE dist = 0)",
    "far AS (SELECT lineage, dist AS far FROM tips JOIN r ON node = tip)",
    "way AS MATERIALIZED (SELECT x.node, x.lineage, round(0.5 * (far + r.dist - x.dist), 9) AS along FROM (SELECT 0 AS lineage, * FROM a UNION ALL SELECT 1, * FROM b) x JOIN far USING (lineage) JOIN r ON r.node = x.node)",
])


def _lines(spark: SparkSession, d: str) -> tuple[list[int], DataFrame]:
    """Two tips seen from the points of label 0, and how far each point runs along the way to either."""
    p = _points(spark, d)
    edges = T.neighbour_edges(p)
    root = T.geodesics(edges, p.where("label = 0").select(F.lit(0).alias("source"), F.col("id").alias("node"))).select("node", "dist")
    tips, ways = T.ends(edges, root, 2)
    return tips, T.shared_way(root, ways, tips)


@R.add("x5_geodesics", "WITH " + _EDGES + ", " + _ways_sql("r", "SELECT id AS node FROM latent WHERE label = 0") + " SELECT node, round(dist, 6) AS dist FROM r")
def geodesics(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return T.geodesics(T.neighbour_edges(p), p.where("label = 0").select(F.lit(0).alias("source"), F.col("id").alias("node"))).select("node", F.round("dist", 6).alias("dist"))


@R.add("x5_shared_way", "WITH " + _TREE + " SELECT node, lineage, round(along, 6) AS along FROM way")
def shared_way(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)[1].withColumn("along", F.round("along", 6))


@R.add(
    "x5_places",
    "WITH " + _TREE + """, own AS MATERIALIZED (SELECT node, arg_max(lineage, along - lineage * 1e-12) AS own, max(along) AS progress FROM way GROUP BY 1),
fork AS (SELECT CASE WHEN lineage = 0 THEN 1e300 ELSE along END AS fork, lineage FROM way WHERE node = (SELECT tip FROM tips WHERE lineage = 0)),
spread AS (SELECT node, own, progress, f.lineage, f.lineage <> own AND progress <= least(f.fork, g.fork) AS shared FROM own JOIN fork g ON g.lineage = own CROSS JOIN fork f),
lying AS (SELECT *, bool_or(shared) OVER (PARTITION BY node) AS both_ FROM spread WHERE lineage = own OR shared),
placed AS (SELECT *, row_number() OVER (PARTITION BY lineage, both_ ORDER BY progress, node) AS i, count(*) OVER (PARTITION BY lineage, both_) AS n, count(*) FILTER (both_) OVER (PARTITION BY lineage) / CAST((SELECT count(*) FROM own) AS DOUBLE) AS trunk FROM lying)
SELECT node, lineage, round(CASE WHEN both_ THEN trunk * (i - 1) / n ELSE trunk + (1 - trunk) * i / n END, 6) AS t FROM placed""",
)
def places(spark: SparkSession, d: str) -> DataFrame:
    tips, along = _lines(spark, d)
    return T.places(along, tips).withColumn("t", F.round("t", 6))


@R.add("c4_bayesian_merges")
def bayesian_merges(spark: SparkSession, d: str) -> DataFrame:
    labels = S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("label"))
    return C.bayesian_merges(A.grouped_sums(S.customer_counts(spark, d), labels))[0]


@R.add("c7_anchors")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    m = A.vector_mean(_points(spark, d), ["label"]).select(F.col("label").alias("pb"), F.col("mean").alias("vec"))
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(C.anchors(m, 5))], "step int, pb int")


_C8 = dict(
    c="SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM (SELECT label, dim, avg(x) AS m FROM dims GROUP BY 1, 2)",
    s="SELECT id, c.label AS topic, sum(x * c) AS s FROM dims JOIN c USING (dim) GROUP BY 1, 2",
)


@R.add("c8_topics_theta", sql("SELECT id, topic AS label, round(ln(e / greatest(sum(e) OVER (PARTITION BY id), 1e-8) + 1e-8), 6) AS log_theta FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM s)", "latent", "dims", **_C8))
def topics_theta(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    _, theta, _ = C.cluster_topics(p, p.select(F.col("id").alias("feature_id"), F.col("vec").alias("rho")))
    return theta.withColumn("log_theta", F.round("log_theta", 6))


@R.add(
    "c8_topics_beta",
    sql(
        "SELECT id AS feature_id, label, round(l - (mx + ln(sum(exp(l - mx)) OVER (PARTITION BY label))), 6) AS beta FROM (SELECT *, max(l) OVER (PARTITION BY label) AS mx FROM lo)",
        "latent",
        "dims",
        **_C8,
        lo="SELECT id, o.label, sum(x * g) AS l FROM dims JOIN (SELECT label, dim, c - avg(c) OVER (PARTITION BY dim) AS g FROM c) o USING (dim) GROUP BY 1, 2",
    ),
)
def topics_beta(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    _, _, beta = C.cluster_topics(p, p.select(F.col("id").alias("feature_id"), F.col("vec").alias("rho")))
    return beta.withColumn("beta", F.round("beta", 6))


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Three models of the groups (label, hash of the id by tens): the first half, the second half, all dimensions."""
    p = _points(spark, d).withColumn("pb", F.concat_ws("-", F.col("label").cast("string"), (F.col("id") % 8).cast("string")))
    out = None
    for model, vec in (("first", F.slice("vec", 1, 32)), ("second", F.slice("vec", 33, 32)), ("whole", F.col("vec"))):
        m = N.group_means(p.withColumn("vec", vec), 2).withColumn("model", F.lit(model)).select("model", "pb", "vec")
        out = m if out is None else out.unionByName(m)
    return out


_RANKS = dict(
    g="SELECT id, concat(label, '-', id % 8) AS pb, dim, x FROM dims",
    v="SELECT model, pb, list(m ORDER BY dim) AS vec FROM (SELECT CASE WHEN dim < 32 THEN 'first' ELSE 'second' END AS model, pb, dim, avg(x) AS m, count(*) AS n FROM g GROUP BY 1, 2, 3 UNION ALL SELECT 'whole', pb, dim, avg(x), count(*) FROM g GROUP BY 1, 2, 3) WHERE n >= 2 GROUP BY 1, 2",
    d=f"SELECT a.model, a.pb AS a, b.pb AS b, {_D2} AS d2 FROM v a JOIN v b ON a.model = b.model AND a.pb <> b.pb",
    r="SELECT model, least(a, b) AS pb_a, greatest(a, b) AS pb_b, min(r) AS rank FROM (SELECT *, rank() OVER (PARTITION BY model, a ORDER BY d2) AS r FROM d) GROUP BY 1, 2, 3",
    k="SELECT DISTINCT least(a, b) AS pb_a, greatest(a, b) AS pb_b FROM (SELECT *, row_number() OVER (PARTITION BY model, a ORDER BY d2, b) AS q FROM d) WHERE q <= 5",
    grid="SELECT m.model, k.pb_a, k.pb_b, r.rank FROM k CROSS JOIN (SELECT DISTINCT model FROM v) m LEFT JOIN r ON r.model = m.model AND r.pb_a = k.pb_a AND r.pb_b = k.pb_b",
    ans="SELECT g.model, g.pb_a, g.pb_b, median(o.rank) AS answer FROM grid g JOIN grid o ON g.pb_a = o.pb_a AND g.pb_b = o.pb_b AND g.model <> o.model WHERE o.rank IS NOT NULL GROUP BY 1, 2, 3",
)
_FAR = "greatest(10, ceil((SELECT count(DISTINCT pb) FROM v) * 0.25))"


@R.add("w2_pair_ranks", sql("SELECT model, pb_a, pb_b, rank FROM r", "latent", "dims", **{k: _RANKS[k] for k in ("g", "v", "d", "r")}))
def pair_ranks(spark: SparkSession, d: str) -> DataFrame:
    return N.pair_ranks(_views(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@R.add("h18_critique", sql(f"SELECT grid.model, grid.pb_a, grid.pb_b, rank, answer, rank <= 5 AS near, coalesce(rank <= 5 AND answer > {_FAR}, false) AS merged FROM grid LEFT JOIN ans USING (model, pb_a, pb_b)", "latent", "dims", **_RANKS))
def critique(spark: SparkSession, d: str) -> DataFrame:
    return N.critique(_views(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


@R.add("h18_critique_summary", sql(f"SELECT model, count(*) FILTER (rank <= 5) AS near_pairs, count(*) FILTER (rank <= 5 AND answer > {_FAR}) AS merges, round(count(*) FILTER (rank <= 5 AND answer > {_FAR}) / CAST(nullif(count(*) FILTER (rank <= 5), 0) AS DOUBLE), 6) AS merge_rate FROM grid LEFT JOIN ans USING (model, pb_a, pb_b) GROUP BY 1", "latent", "dims", **_RANKS))
def critique_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.critique_summary(N.critique(_views(spark, d), 5)).withColumn("merge_rate", F.round("merge_rate", 6))


_FIT = "SELECT cell_id, stratum, round(sum(value * ln(greatest(share, 1e-12))) / sum(value), 9) AS fit FROM counts JOIN composition USING (feature_id) JOIN cells USING (cell_id) GROUP BY 1, 2"


@R.add(
    "h14_probe",
    sql(
        "SELECT round(threshold, 6) AS threshold, cells, flagged, round(flagged / CAST(cells AS DOUBLE), 6) AS flag_rate, flagged / CAST(cells AS DOUBLE) > 0.05 AND (flagged / CAST(cells AS DOUBLE) - 0.05) / greatest(sqrt(0.05 * 0.95 / cells), 1e-12) > 1.6448536 AS novel FROM (SELECT threshold, count(*) AS cells, count(*) FILTER (fit < threshold) AS flagged FROM f, t WHERE stratum = 'MACHINERY' GROUP BY 1)",
        "counts",
        "cells",
        "composition",
        f=_FIT,
        t="SELECT fit AS threshold FROM (SELECT fit, row_number() OVER (ORDER BY fit) - 1 AS r, count(*) OVER () AS n FROM f WHERE stratum <> 'MACHINERY') WHERE r = floor(0.05 * (n - 1) + 0.5)",
    ),
)
def probe(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment against a threshold calibrated on the others."""
    counts = S.customer_counts(spark, d)
    s = P.null_scores(counts, A.composition(counts)).join(S.customer_cells(spark, d).select("cell_id", "stratum"), "cell_id")
    p = N.probe(s.where("stratum != 'MACHINERY'"), s.where("stratum = 'MACHINERY'"))
    return p.select(F.round("threshold", 6).alias("threshold"), "cells", "flagged", F.round("flag_rate", 6).alias("flag_rate"), "novel")


_IMPUTE = dict(
    q="SELECT id, vec FROM latent WHERE label < 5",
    f="SELECT id, vec FROM latent WHERE label >= 5",
    k=f"SELECT * FROM (SELECT a.id AS a, b.id AS b, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS r FROM q a CROSS JOIN f b) WHERE r <= 25",
    w="SELECT a, b, e / greatest(sum(e) OVER (PARTITION BY a), 1e-12) AS w FROM (SELECT a, b, exp(-(d2 - min(d2) OVER (PARTITION BY a)) / 2.0) AS e FROM k)",
)


@R.add("h17_impute", sql("SELECT a AS cell_id, feature_id, round(sum(w * value), 5) AS value FROM w JOIN counts ON cell_id = b GROUP BY 1, 2", "latent", "counts", **_IMPUTE))
def impute(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return N.impute(p.where("label < 5"), p.where("label >= 5"), S.customer_counts(spark, d)).withColumn("value", F.round("value", 5))


@R.add(
    "h17_indexed",
    sql(
        "SELECT a AS cell_id, feature_id, round(sum(w * value), 5) AS value FROM w JOIN counts ON cell_id = b GROUP BY 1, 2",
        "latent", "counts", q=_IMPUTE["q"], **{n: x.replace("latent", "f" if n == "centers" else "latent") for n, x in (("f", "SELECT id, vec FROM latent WHERE label >= 5"), ("centers", _INDEX["centers"]), ("places", _INDEX["places"]))},
        found=f"SELECT a.id AS a, b.id AS b, {_D2} AS d2 FROM q a JOIN places p ON p.id = a.id AND p.place <= {_PROBES} JOIN places l ON l.list = p.list AND l.place = 1 JOIN f b ON b.id = l.id",
        k="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM found) WHERE r <= 25", w=_IMPUTE["w"],
    ),
)
def impute_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Imputation on neighbours that the index finds."""
    p = _points(spark, d)
    query, reference = p.where("label < 5"), p.where("label >= 5")
    near = I.search(I.build(reference, _LISTS, passes=0), query, 25, _PROBES)
    return N.impute(query, reference, S.customer_counts(spark, d), near=near).withColumn("value", F.round("value", 5))


_RHO = "SELECT id AS feature_id, dim, x AS r FROM dims"
_SUMS = "SELECT label, dim, sum(x) AS total, count(*) AS n FROM dims GROUP BY 1, 2"
_GAP = "SELECT label, dim, total / n - (sum(total) OVER (PARTITION BY dim) - total) / (sum(n) OVER (PARTITION BY dim) - n) AS gap FROM s"


@R.add("v1_contrasts", sql("SELECT label, id AS feature_id, round(sum(x * gap), 5) AS lfc FROM dims JOIN g USING (dim) GROUP BY 1, 2".replace("SELECT label", "SELECT g.label"), "latent", "dims", s=_SUMS, g=_GAP))
def contrasts(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return W.contrasts(A.vector_sums(p, "label"), p.select(F.col("id").alias("feature_id"), F.col("vec").alias("rho"))).withColumn("lfc", F.round("lfc", 5))


@R.add(
    "v1_topic_contrast",
    sql(
        "SELECT label, f AS feature_id, round(ln(greatest(sum(p * i), 1e-12) / greatest(sum(p * o), 1e-12)), 6) AS lfc FROM m JOIN b USING (k) GROUP BY 1, 2",
        "latent",
        "dims",
        t="SELECT id, label, dim AS k, exp(x) / sum(exp(x)) OVER (PARTITION BY id) AS t FROM dims",
        s="SELECT label, k, sum(t) AS total, count(*) AS n FROM t GROUP BY 1, 2",
        m="SELECT label, k, total / n AS i, (sum(total) OVER (PARTITION BY k) - total) / (sum(n) OVER (PARTITION BY k) - n) AS o FROM s",
        b="SELECT p_partkey AS f, dim AS k, (1 + (p_partkey * (dim + 3)) % 17) / 17.0 AS p FROM part, (SELECT DISTINCT dim FROM dims)",
    ),
)
def topic_contrast(spark: SparkSession, d: str) -> DataFrame:
    theta = S.latent(spark, d).select("label", F.posexplode(V.softmax("vec")).alias("k", "t")).groupBy("label", "k").agg(F.sum("t").alias("total"), F.count(F.lit(1)).alias("n"))
    beta = S.part_features(spark, d).select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).withColumn("p", (1 + (F.col("feature_id") * (F.col("k") + 3)) % 17) / 17.0)
    return W.topic_contrast(theta, beta).withColumn("lfc", F.round("lfc", 6))


_MEANS = "SELECT stratum AS label, feature_id, sum(ln(1 + value)) / n AS mean FROM counts JOIN cells USING (cell_id) JOIN (SELECT stratum, count(*) AS n FROM cells GROUP BY 1) USING (stratum) GROUP BY 1, 2, n"


def _group_means(spark: SparkSession, d: str) -> DataFrame:
    return A.group_log_means(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("stratum").alias("label")))


@R.add(
    "v2_variability",
    sql(
        "SELECT feature_id, round(max(mean) / avg(mean), 6) AS score FROM m JOIN (SELECT feature_id FROM v WHERE variance >= (SELECT variance FROM (SELECT variance, row_number() OVER (ORDER BY variance) - 1 AS r, count(*) OVER () AS n FROM v) WHERE r = n // 2)) USING (feature_id) GROUP BY 1",
        "counts",
        "cells",
        m=_MEANS,
        v="SELECT p_partkey AS feature_id, p_retailprice AS variance FROM part",
    ),
)
def variability(spark: SparkSession, d: str) -> DataFrame:
    v = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("variance"))
    return W.variability(_group_means(spark, d), v).withColumn("score", F.round("score", 6))


@R.add("v3_union_contrast", sql("SELECT id AS feature_id, round(sum(x * gap), 5) AS lfc FROM dims JOIN g USING (dim) GROUP BY 1", "latent", "dims", g="SELECT dim, avg(x) FILTER (label IN (1, 2, 3)) - avg(x) FILTER (label NOT IN (1, 2, 3)) AS gap FROM dims GROUP BY 1"))
def union_contrast(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return W.union_contrast(A.vector_sums(p, "label"), [1, 2, 3], p.select(F.col("id").alias("feature_id"), F.col("vec").alias("rho"))).withColumn("lfc", F.round("lfc", 5))


@R.add(
    "v4_set_levels",
    sql("SELECT p, round(avg(least(greatest(x / hi, 0), 1)), 6) AS level FROM o, (SELECT max(CASE WHEN r = floor((n - 1) * 0.99) THEN x END) AS hi FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM o)) GROUP BY 1", o="SELECT o_orderpriority AS p, o_totalprice AS x FROM orders"),
)
def set_levels(spark: SparkSession, d: str) -> DataFrame:
    return W.set_levels(S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("x")), "p", "x").withColumn("level", F.round("level", 6))


@R.add(
    "v5_near_features",
    sql(
        "SELECT a, b, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM (SELECT a.id AS a, b.id AS b, round(list_sum([z[1] * z[2] FOR z IN list_zip(a.vec, b.vec)]), 9) AS c FROM u a JOIN u b ON a.id <> b.id)) WHERE r <= 5",
        "latent",
        u="SELECT id, [x / sqrt(list_sum([y * y FOR y IN vec])) FOR x IN vec] AS vec FROM latent",
    ),
)
def near_features(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return W.near(p, p, 5, same=True).withColumn("cosine", F.round("cosine", 6))


@R.add("v6_dominant_topic", sql("SELECT id AS cell_id, CAST(list_position(vec, list_max(vec)) - 1 AS INTEGER) AS topic FROM latent", "latent"))
def dominant(spark: SparkSession, d: str) -> DataFrame:
    return W.dominant(S.latent(spark, d)).select("cell_id", "topic")


@R.add("v7_heatmap", sql("SELECT label, feature_id, round(margin, 6) AS margin, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin DESC, feature_id) AS rank FROM (SELECT feature_id, max(CASE WHEN r = 1 THEN label END) AS label, round(max(CASE WHEN r = 1 THEN mean END) - coalesce(max(CASE WHEN r = 2 THEN mean END), 0), 9) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY mean DESC, label) AS r FROM m) GROUP BY 1)) WHERE rank <= 10", "counts", "cells", m=_MEANS))
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return W.heatmap(_group_means(spark, d), 10).select("label", "feature_id", F.round("margin", 6).alias("margin"), F.col("rank").cast("long").alias("rank"))


@R.add("v8_structure_order", sql("SELECT cell_id, topic, row_number() OVER (ORDER BY topic, w DESC, cell_id) AS place FROM (SELECT id AS cell_id, CAST(list_position(vec, list_max(vec)) - 1 AS INTEGER) AS topic, list_max(vec) AS w FROM latent)", "latent"))
def structure_order(spark: SparkSession, d: str) -> DataFrame:
    return W.structure_order(S.latent(spark, d)).withColumn("place", F.col("place").cast("long"))


def _map(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", "label", F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"), F.get("vec", 2).alias("vx"), F.get("vec", 3).alias("vy"))


@R.add("v9_nearest_point", sql("SELECT id FROM latent ORDER BY (vec[1] - 0.1) * (vec[1] - 0.1) + (vec[2] + 0.2) * (vec[2] + 0.2), id LIMIT 1", "latent"))
def nearest_point(spark: SparkSession, d: str) -> DataFrame:
    return W.nearest_point(_map(spark, d), 0.1, -0.2)


@R.add(
    "v10_marker_fit",
    sql(
        "SELECT l.label, t.type, round(coalesce(s, 0) / t.n, 6) AS fit FROM (SELECT DISTINCT label FROM m) l CROSS JOIN (SELECT brand AS type, count(*) AS n FROM features GROUP BY 1) t LEFT JOIN (SELECT label, brand AS type, sum(mean) AS s FROM m JOIN features USING (feature_id) GROUP BY 1, 2) x ON x.label = l.label AND x.type = t.type",
        "counts",
        "cells",
        "features",
        m=_MEANS,
    ),
)
def marker_fit(spark: SparkSession, d: str) -> DataFrame:
    f = S.part_features(spark, d).select("feature_id", F.col("brand").alias("type"))
    return W.marker_fit(_group_means(spark, d).withColumnRenamed("mean", "score"), f).withColumn("fit", F.round("fit", 6))


@R.add("l1_layout_features", sql("SELECT id, dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_pop(x) OVER (PARTITION BY dim), 6) AS z FROM dims", "latent", "dims"))
def layout_features(spark: SparkSession, d: str) -> DataFrame:
    z = N.in_metric(_points(spark, d).select("id", "vec"), "signed").select("id", F.posexplode("vec").alias("dim", "z"))
    return z.select("id", F.col("dim").cast("long").alias("dim"), F.round("z", 6).alias("z"))


@R.add(
    "l4_place",
    sql(
        "SELECT a AS cell_id, round(sum(w * x) / sum(w), 5) AS x, round(sum(w * y) / sum(w), 5) AS y FROM (SELECT k.a, exp(-pow(d2 / max(d2) OVER (PARTITION BY k.a), 5.0)) AS w, k.x, k.y FROM k) GROUP BY 1",
        "latent",
        "dims",
        c="SELECT label, list(m ORDER BY dim) AS vec FROM (SELECT label, dim, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1",
        k=f"SELECT * FROM (SELECT a.id AS a, b.vec[1] AS x, b.vec[2] AS y, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.label) AS r FROM latent a CROSS JOIN c b) WHERE r <= 3",
    ),
)
def place(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    m = A.vector_mean(p, ["label"]).select(F.col("label").alias("id"), F.col("mean").alias("vec"), F.get("mean", 0).alias("x"), F.get("mean", 1).alias("y"))
    return W.place(p, m).select("cell_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@R.add("l5_grid_arrows", sql("SELECT CAST(floor(vec[1] / 0.1) AS BIGINT) AS gx, CAST(floor(vec[2] / 0.1) AS BIGINT) AS gy, count(*) AS n, round(avg(vec[3]), 6) AS vx, round(avg(vec[4]), 6) AS vy FROM latent GROUP BY 1, 2 HAVING count(*) >= 3", "latent"))
def grid_arrows(spark: SparkSession, d: str) -> DataFrame:
    g = W.grid_arrows(_map(spark, d), 0.1, 3)
    return g.select("gx", "gy", "n", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


_ONE = "SELECT k.a AS id, rank, (b.vec[1] - a.vec[1]) AS dx, (b.vec[2] - a.vec[2]) AS dy, sqrt((b.vec[1] - a.vec[1]) ** 2 + (b.vec[2] - a.vec[2]) ** 2) AS len FROM k JOIN latent a ON a.id = k.a JOIN latent b ON b.id = k.b"


@R.add("l5_neighbour_velocity", sql("SELECT id, round(sum((11 - rank) / 55.0 * dx / len) - avg(dx / len), 6) AS vx, round(sum((11 - rank) / 55.0 * dy / len) - avg(dy / len), 6) AS vy FROM m WHERE len > 0 GROUP BY 1", "latent", k=_KNN, m=_ONE))
def neighbour_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Directions to ten neighbours, the nearer the more, on a map of two dimensions."""
    p = _points(spark, d)
    near = N.nearest(p, p, 10, same=True).select("a", "b", ((11 - F.col("rank")) / 55.0).alias("w"))
    v = O.by_neighbours(near, p.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")))
    return v.select("id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@R.add("l5_streamlines")
def streamlines(spark: SparkSession, d: str) -> DataFrame:
    """A line through the middle of every square."""
    g = W.grid_arrows(_map(spark, d), 0.1, 3)
    seeds = g.select((F.col("gx") * 100_000 + F.col("gy")).alias("id"), ((F.col("gx") + 0.5) * 0.1).alias("x"), ((F.col("gy") + 0.5) * 0.1).alias("y"))
    return O.streamlines(g, seeds, 0.1)


@R.add("h19_gram", sql("SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(sum(a.x * b.x), 5) AS g FROM dims a JOIN dims b ON a.id = b.id AND a.dim <= b.dim GROUP BY 1, 2", "latent", "dims"))
def gram(spark: SparkSession, d: str) -> DataFrame:
    return W.gram(_points(spark, d)).select("i", "j", F.round("g", 5).alias("g"))


@R.add("h19_diagnosis")
def diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(sorted(W.embedding_diagnosis(_points(spark, d)).items()), "measure string, value double")


del Window
